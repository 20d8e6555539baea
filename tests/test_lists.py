from pathlib import Path

import numpy as np
import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyweave import store
from tallyweave.operators import blocking, lists
from tallyweave.plans import queries

SF = "/root/testdata/sf0.001"
COLS = "id string, name string, addr string, country string"


@pytest.mark.parametrize("part, at_once, shared", [(500, 10_000_000, 100), (500, 1200, 100)], ids=["parts", "rounds"])
@pytest.mark.parametrize("name", ["q_candidates", "q_block_scores", "q_topk_g1"])
def test_parts_and_rounds_against_sql(spark, monkeypatch, name, part, at_once, shared):
    for k, v in {"PART": part, "ROUND": at_once, "SHARED": shared}.items():
        monkeypatch.setattr(blocking, k, v)
    assert oracle.compare(queries.QUERIES[name](spark, SF), oracle.connection(SF), queries.ORACLES[name]) > 0


def test_pairs_are_not_written(spark, tmp_path, monkeypatch):
    """Every record shares a word with every other: 300 * 900 pairs, of which few are listed."""
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    a, b = (spark.range(n).selectExpr(f"concat('{s}-', id) AS id", "concat('common w', id % 50) AS name", "'' AS addr", "'US' AS country") for s, n in (("S1", 300), ("S2", 900)))
    got = blocking.block(a, b).count()
    assert 300 * 15 <= got <= 300 * 60
    rows = {}
    for f in Path(tmp_path).rglob("*.parquet"):
        top = f.relative_to(tmp_path).parts[:2]
        rows[top] = rows.get(top, 0) + pq.ParquetFile(f).metadata.num_rows
    assert rows and max(rows.values()) < 20_000


def test_no_targets_in_common(spark):
    a, b = spark.createDataFrame([("S1-1", "one", "", "US")], COLS), spark.createDataFrame([("S2-1", "two", "", "DE")], COLS)
    assert blocking.block(a, b).count() == 0 and blocking.scored_pairs(a, b).count() == 0 and blocking.block(a, b.limit(0)).count() == 0


def test_countries_are_dealt(monkeypatch):
    for k, v in {"PART": 10, "ROUND": 30, "SHARED": 4}.items():
        monkeypatch.setattr(blocking, k, v)
    rows, rounds = blocking._dealt([("a", 45), ("b", 12), ("c", 3), ("d", 1), ("e", 1), ("f", 18)])
    assert rows == [("a", 5, 0), ("f", 2, 5), ("b", 2, 7), ("c", 1, 9), ("d", 1, 9), ("e", 1, 10)]
    assert sorted(k for r in rounds for k in r) == list(range(11)) and rounds[0] == [0, 1, 2]
    assert blocking._dealt([]) == ([], [[]])


def test_lists_of_a_part_keep_ties_in_order():
    rng = np.random.default_rng(1)
    sums = rng.integers(0, 6, (4, 3000)) / 7.0
    has_addr = rng.random(3000) < 0.9
    ks = [15, 10, 5, 5, 10, 10, 15]
    want = set()
    for i, k in enumerate(ks):
        key = lists._key(i, lists.nine(sums), has_addr)
        want |= {int(x) for x in np.lexsort((np.arange(3000), -key))[:k] if key[x] > 0}
    assert lists._listed(sums, has_addr, ks).tolist() == sorted(want)


def test_a_token_twice_counts_twice():
    x = lists.part(0, np.array([4, 9]), pa.table({"n": [9, 4, 9], "t": [1, 1, 1], "w": [0.5, 1.0, 0.25]}))
    assert x.tokens.tolist() == [1] and x.starts.tolist() == [0, 2] and x.at.tolist() == [0, 1] and x.w.tolist() == [1.0, 0.75]


def test_all_pairs_take_few_bytes(spark, tmp_path):
    """Every one of 60 S1 records shares a word with every one of 30,000 targets. Written in the order of ids, a pair took over 4 bytes."""
    a, b = (spark.range(n).selectExpr(f"concat('{s}-', id) AS id", "concat('common w', id % 50, ' v', id % 331) AS name", "concat('road ', id % 17, ' x', id % 101) AS addr", "'US' AS country") for s, n in (("S1", 60), ("S2", 30_000)))
    blocking.scored_pairs(a, b, decimals=4).write.parquet(f"{tmp_path}/pairs")
    files = [pq.ParquetFile(f).metadata for f in Path(tmp_path).rglob("*.parquet")]
    columns = [m.row_group(i).column(j) for m in files for i in range(m.num_row_groups) for j in range(m.num_columns)]
    assert sum(m.num_rows for m in files) == 60 * 30_000
    assert sum(c.total_compressed_size for c in columns) < 3 * 60 * 30_000


@pytest.mark.parametrize("g", [np.array([[0.5, 0, 0.5, 0.5, 0], [0, 0, 0, 0, 0], [0.25, 0.1, 0.2, 0.25, 0.1], [0.1, 0.3, 0.1, 0.1, 0.3]]), np.array([[9e8, 0, 9e8], [8e8, 1, 8e8], [0, 0, 0], [1, 2, 1]])], ids=["small", "large"])
def test_equal_scores_stand_together(g):
    got = [tuple(x) for x in g[:, lists._by_scores(g, 4)].T]
    assert got == sorted(map(tuple, g.T))


def test_parts_at_least(monkeypatch):
    for k, v in {"PART": 10, "ROUND": 30, "SHARED": 4}.items():
        monkeypatch.setattr(blocking, k, v)
    assert blocking._dealt([("a", 25), ("b", 8)], {"a": 4, "b": 1})[0] == [("a", 4, 0), ("b", 1, 4)]
