import pytest

from tessera.functions import prompts
from tessera.operators.repair import _json_str
from tessera.sources import pairs
from tessera.streaming.ingest import stream_ingest


def _file(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_file_without_ids(spark, tmp_path):
    path = _file(tmp_path / "a", "x.csv", "nlq,sql\nhow many,SELECT 1\n,SELECT 2\nhow many,SELECT 1\n")
    got = pairs.read_pairs_csv(spark, path).collect()
    assert len(got) == 3 and all(r.pair_id is not None for r in got) and len({r.pair_id for r in got}) == 2
    again = pairs.read_pairs_csv(spark, path).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_stream_without_ids_and_by_header(spark, tmp_path):
    source = _file(tmp_path / "s", "x.csv", "sql,nlq\nSELECT 1,how many\nSELECT 2,\nSELECT 1,how many\n")
    table = str(tmp_path / "t")
    for k in range(2):
        rows = stream_ingest(spark, source, table, str(tmp_path / f"c{k}"), digits=1).rows().collect()
    assert sorted((r.nlq, r.sql) for r in rows) == [("", "SELECT 2"), ("how many", "SELECT 1")]
    assert all(r.pair_id is not None for r in rows)
    with pytest.raises(ValueError):
        stream_ingest(spark, _file(tmp_path / "n", "x.csv", "nlq,query\na,b\n"), table, str(tmp_path / "c9"))


def test_confidence_is_over_recorded_hits(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, "q", "SELECT 1"), (1, 2, 0.1, None, None)], "query_id long, rank int, score double, nlq string, sql string")
    row = prompts.example_blocks(hits, mean_alias="confidence").first()
    assert (row.confidence, row.n_examples) == (0.9, 1)


def test_json_text(spark):
    text = 'a"b\\c\r\n\t\b\f\x01é'
    import json

    got = spark.createDataFrame([(text,)], "v string").select(_json_str("v").alias("j")).first().j
    assert json.loads(got) == text


def test_prompt_lines_from_their_parts(spark):
    """A line reads as its form does, without a formatter that reads the form for each hit."""
    from tessera.functions import prompts

    hits = spark.createDataFrame([(1, 1, 0.875, "q %s", "s%d"), (1, 2, 0.25, "r", "t"), (2, 1, 1234.5, "a", "b")],
                                 "query_id long, rank long, score double, nlq string, sql string")
    blocks = prompts.example_blocks(hits)
    assert "format_string(-- Example" not in blocks._jdf.queryExecution().optimizedPlan().toString()
    got = {r.query_id: r.examples_block for r in blocks.collect()}
    line = prompts.EXAMPLE_LINE
    assert got == {1: line % (1, 0.88, "q %s", "s%d") + "\n\n" + line % (2, 0.25, "r", "t"), 2: line % (1, 1234.5, "a", "b")}
