"""What a new document asks of its state: no page that cannot be there, one timer."""

from datetime import timedelta
from unittest.mock import MagicMock

from lectern.streaming import documents
from pyspark.sql import Row


def test_new_documents_ask_little():
    own = documents.Pages(timedelta(seconds=1), timedelta(seconds=9))
    own.handle = own.pages = own.times = state = MagicMock()
    state.times = state.get.return_value = None
    when = MagicMock(getCurrentWatermarkInMs=lambda: 0)
    rows = [Row(doc_id=1, page=p, text=t, at=at) for p, t, at in ((1, "old", 10), (1, "new", 20), (2, None, 5), (1, "late", 10))]
    assert list(own.handleInputRows((1,), iter(rows), when)) == []
    assert [c.args for c in state.updateValue.call_args_list] == [((1,), ("new", 20)), ((2,), ("", 5))]
    assert not state.getValue.called and not state.containsKey.called
    assert [c.args for c in state.registerTimer.call_args_list] == [(1020,)] and state.update.call_args.args == ((1020, 9020),)
