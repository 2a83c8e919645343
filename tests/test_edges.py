"""The pN queries on tables with rows of NULLs, repeated rows, columns of clashing names, and on empty tables."""

import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.conftest import DATA
from tidemark.plans.problems import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")

TABLES = ["player_snapshot", "player_match", "fixture", "gameweek", "ban_event", "bootstrap_element", "player_dim", "team_dim", "run_manifest", "raw_fixture_row", "feed", "eval_item", "mix_target", "documents"]
CLASHES = ["k", "v", "value", "level", "rank", "day", "at_us", "label", "tokens", "start", "kind", "key", "seq", "leaf", "node", "side", "field", "instant_us", "block", "e", "d", "t", "b"]


def variant(directory: str, kind: str) -> str:
    """Copies of the small tables: 'empty', or 'dirty' with NULL rows, repeats and clashing columns."""
    os.makedirs(directory, exist_ok=True)
    for name in TABLES:
        t = pq.read_table(f"{DATA}/{name}.parquet")
        t = t.cast(pa.schema([f.with_nullable(True) for f in t.schema]))
        if kind == "empty":
            t = t.slice(0, 0)
        else:
            nulls = pa.table({f.name: pa.nulls(2, f.type) for f in t.schema}, schema=t.schema)
            t = pa.concat_tables([t, nulls])
            for c in CLASHES:
                if c not in t.column_names:
                    t = t.append_column(c, pa.array(["clash"] * len(t)))
        pq.write_table(t, f"{directory}/{name}.parquet")
    return directory


@pytest.fixture(scope="module")
def dirty(tmp_path_factory):
    d = variant(str(tmp_path_factory.mktemp("dirty")), "dirty")
    yield d
    shutil.rmtree(d)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    d = variant(str(tmp_path_factory.mktemp("empty")), "empty")
    yield d
    shutil.rmtree(d)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_dirty_rows_change_nothing(spark, rows, dirty, name):
    fn = QUERIES[name][0]
    got, want = rows(fn(spark, dirty)), rows(fn(spark, DATA))
    spark.catalog.clearCache()
    if name == "p3_verdicts":  # every cell comes out, those of the NULL rows as no time
        assert len(got) == len(want) + 4
    else:
        assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name][0](spark, empty).count() == 0
    spark.catalog.clearCache()
