"""Live streams over a table that is a folder of part files, or one file."""

from vetloom.catalog import load_all
from vetloom.sources.tables import SCHEMAS, Tables, read_table


def test_live_reads_all_part_files(spark, tables, tmp_path):
    load_all()
    from vetloom.catalog import streams

    events = read_table(spark, tables.directory, "events")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    assert len(list((tmp_path / "events.parquet").glob("part-*.parquet"))) == 4
    for t in (Tables(spark, str(tmp_path)), tables):
        got = streams.drained(t, streams.live(t, "events"))
        assert got.columns == [c.split()[0] for c in SCHEMAS["events"].split(", ")]
        assert got.count() == events.count() and got.exceptAll(events).isEmpty()
