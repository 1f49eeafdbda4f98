"""Replays arrive in as many micro-batches whatever the number of files."""

import pytest

from turnledger.catalog import ingest_queries
from turnledger.sources.files import Source


class Asked(Exception):
    pass


@pytest.mark.parametrize("files, least", [(4, 1), (40, 10), (4_000, 1_000)])
def test_micro_batches_do_not_grow_with_the_files(spark, monkeypatch, files, least):
    def asked(*args, files_per_trigger):
        raise Asked(files_per_trigger)

    monkeypatch.setattr(ingest_queries, "write_message_logs", lambda *_: Source("claude_code", ("/logs",)))
    monkeypatch.setattr(ingest_queries, "list_files", lambda *_: spark.range(files))
    monkeypatch.setattr(ingest_queries, "usage_stream", asked)
    with pytest.raises(Asked) as found:
        ingest_queries.stream_replays(spark, "/none")
    assert found.value.args[0] >= least
