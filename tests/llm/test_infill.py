"""Fill-in-middle against plain loops over code points."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexweave.llm import infill
from lexweave.llm.buffers import Ranks, Texts, runs


def plainly(doc_id, text, seed="1"):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_equals_plain_loops(spark, odd, empty):
    given = [(r.doc_id, r.text) for r in odd.collect()]
    assert ordered(infill.fill_in_middle(odd).collect()) == ordered(plainly(*r) for r in given)
    assert infill.fill_in_middle(empty).count() == 0


def test_cuts_near_sentinels_and_wide_letters(spark):
    pick = random.Random(3)
    signs = ["<", "P", ">", "S", "M", "a", "Z", " ", "\n", "é", "漢", "\U0001f600", "<P", "S>", "\x00", "1"]
    rows = [(i, "".join(pick.choices(signs, k=pick.randrange(12)))) for i in range(600)] + [(i, "<P>") for i in range(3)]
    found = infill.fill_in_middle(rows_of(spark, rows))
    assert ordered(found.collect()) == ordered(plainly(*r) for r in rows)
    back = found.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("text"))
    assert ordered(back.collect()) == ordered(rows)
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}


def test_rates_and_seed(spark):
    rows = [(i, f"word {i}") for i in range(200)]
    forms = lambda **given: [r.form for r in infill.fill_in_middle(rows_of(spark, rows), **given).orderBy("doc_id").collect()]
    assert set(forms(rate=0)) == {"plain"} and set(forms(rate=100, spm_rate=100)) == {"spm"} and forms(seed="1") == forms() != forms(seed="2")


def test_digests(spark, odd):
    for r in infill.digests(odd).collect():
        texts = [t for i, t in ((x.doc_id, x.text or "") for x in odd.collect()) if i == r.doc_id]
        assert r.restored_sha256 in {hashlib.sha256(t.encode()).hexdigest() for t in texts}


def test_blocks_and_slices_of_arrow_buffers():
    pick = np.random.default_rng(5)
    mask = pick.random(1000) < 0.3
    for block in (1, 7, 1000, 4096):
        ranks, places = Ranks(mask, block), pick.integers(0, 1001, 200)
        assert ranks.before(places).tolist() == [int(mask[:p].sum()) for p in places]
        wanted = pick.integers(0, mask.sum() + 3, 200)
        there = np.flatnonzero(mask).tolist()
        assert ranks.place(wanted).tolist() == [there[k] if k < len(there) else 1000 for k in wanted]
    assert Ranks(np.zeros(0, bool)).before(np.zeros(3, np.int64)).tolist() == [0, 0, 0]
    column = pa.array(["abc", None, "é漢", "", "ab1ab"]).slice(1, 4)
    texts = Texts.of(column)
    assert texts.ends.tolist() == [0, 0, 5, 5, 10] and bytes(texts.data) == "é漢ab1ab".encode()


def test_runs_end_where_texts_end():
    member = np.zeros(256, bool)
    member[list(b"abc")] = True
    texts = Texts.of(pa.array(["xab", "cab", "", "ab", "a-abc"]))
    starts, ends = runs(texts, member, 2)
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(1, 3), (3, 6), (6, 8), (10, 13)]
