import pytest
from pyspark.sql import functions as F

from tallyweave.llm import decontaminate, jaccard, mixing, quality, repeats, sharding

NAMES = ["_row", "copies", "_copy", "_times", "_hits", "_items", "_h", "_entry", "_id", "_text", "_ranges", "n", "node", "p", "shard", "_size", "_index", "files"]
TEXT = "the quick brown fox jumps over the lazy dog and then runs away from it all " * 6
BENCH = "one two three four five six seven eight nine ten eleven twelve thirteen"
ROWS = [(1, TEXT + "alpha", "a"), (2, TEXT + "alpha", "a"), (2, TEXT + "alpha", "a"), (3, None, None), (None, "", "b"), (4, BENCH + " " + BENCH, "a"), (5, "w" * 3000 + " end", "b"), (6, "ä " * 70, None)]
STAGES = {
    "quality": lambda d, b: quality.accepted(d),
    "jaccard": lambda d, b: jaccard.distinct(d),
    "decontaminate": lambda d, b: decontaminate.clean(d, b, max_windows=14),
    "mixing": lambda d, b: mixing.mixed(d),
    "sharding": lambda d, b: sharding.shards(d, 2000),
    "repeats": lambda d, b: repeats.cleaned(d, length=50, gram=8),
}


@pytest.mark.parametrize("stage", STAGES)
@pytest.mark.parametrize("plain", [True, False])
def test_stages_keep_columns_of_any_name(spark, tmp_path, stage, plain):
    """Nulls, repeated rows, empty texts, a long word, and the names that the operators use themselves."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({c: F.coalesce(F.col("doc_id"), F.lit(0)) + k for k, c in enumerate(NAMES)})
    bench = spark.createDataFrame([(1, BENCH), (2, BENCH + " fourteen"), (3, "no"), (3, "no")], "item_id long, text string")
    if plain:
        docs.repartition(3).write.parquet(f"file://{tmp_path}/docs")
        docs = spark.read.parquet(f"file://{tmp_path}/docs")
    out = STAGES[stage](docs, bench)
    replaced = {"shard"} if stage == "sharding" else set()
    assert [c for c in docs.columns if c not in replaced] == [c for c in out.columns if c not in ("shard", "shard_depth", "shard_bytes")] if replaced else out.columns == docs.columns
    got = out.collect()
    assert all(r[c] == (r.doc_id or 0) + k for r in got for k, c in enumerate(NAMES) if c not in replaced)
    ids = sorted(r.doc_id or 0 for r in got)
    if stage == "jaccard":
        assert ids == [0, 1, 3, 4, 5, 6]
    if stage == "decontaminate":
        assert ids == [0, 1, 2, 2, 3, 5, 6]
    if stage in ("sharding", "repeats"):
        assert len(ids) == len(ROWS)
    assert STAGES[stage](docs.limit(0), bench).count() == 0
