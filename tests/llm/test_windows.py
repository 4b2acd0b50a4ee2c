"""Items in blocks, and long ones."""

import random

import llm_brute as brute
import pytest
from pyspark.sql import functions as F

from facelake.llm.decontaminate import Windows, find_windows


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((3, 9, 10, 11, 40, 300, 5))]
    items += [(90, " ".join(f"long{i}" for i in range(900))), (91, None), (None, "no id but these words")]
    docs = [(k, " ".join(rng.choice(words) for _ in range(30)) + " " + items[k % 8][1][k : k + 160]) for k in range(120)]
    docs += [(500, None), (501, ""), (502, "no id but these words"), (503, items[7][1])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [7, 100, 10_000])
def test_blocks_do_not_matter(tables, most):
    docs, items = tables
    found = find_windows(docs, items, block_windows=most)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda x, y: x + y)
    got = {r.id: (r.n_words, r.n, len(r["items"])) for r in found.select("id", "n_words", n_hit.alias("n"), "items").collect()}
    named = [(str(i) if i is not None else None, t) for i, t in map(tuple, items.collect())]
    want = {}
    for doc, n, hit, _, _, _ in brute.decontaminate([tuple(r) for r in docs.collect()], named):
        want[doc] = n, hit
    assert {d: x[:2] for d, x in got.items()} == want
    assert got[502] == (5, 5, 0) and got[503] == (900, 900, 1) and got[500] == (0, 0, 0)


def test_numbers_of_runs_stay_small():
    words = [b"a%d" % i for i in range(5000)]
    block = Windows([("x", words)], 10, 5)
    codes = block.code(next(iter(block.lengths.values()))[1], 5)
    assert codes.max() < 5000**2 and len(block.codes[5]) == 4996
