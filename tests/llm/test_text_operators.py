import json
import math
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexweave.llm import bpe, decontaminate, golay, langid, licences, lm, oracle, quality, simhash
from lexweave.llm.common import slices
from lexweave.llm.components import components
from lexweave.sources import shared

PATH = public_tokenizers.path("word_bpe_49k.json")


# --- BPE


@pytest.fixture(scope="module")
def both():
    with open(PATH) as f:
        return Tokenizer.from_file(PATH), bpe.WordBpe(json.load(f))


def same(both, text):
    library, own = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids, repr(text)
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_library_on_random_texts(both):
    rnd = random.Random(5)
    letters = "abcdefgHELLOthein'sdrevm  \n\t\r 012!?#<|>éÉßüñΣςİ́中文ंि😀\x85\x1c  ﻿"
    for _ in range(3000):
        same(both, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))))


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|startoftext|>b <|endoftext|", "it's we'll 'S", "aaaa" * 999, "ab" * 5000, "ΑΣ ΣΑ", "՘x", "Ᲊ", "Ƛ", "x" * 2001 + "yz"])
def test_bpe_cases(both, text):
    same(both, text)


def test_bpe_letters_of_many_scripts(both):
    for start in range(0, 0x20000, 61):
        if not 0xD800 <= start < 0xE000:
            same(both, f"a{chr(start)}b{chr(start)}1")


def test_bpe_long_word_by_either_way(both):
    rnd = random.Random(2)
    word = bytes(rnd.choice(b"abcdefghijklmnop") for _ in range(1500))
    assert both[1].merge([word])[0] == both[1].merge_long(word)


def test_bpe_with_little_memory(both, spark, monkeypatch):
    """Chunks over the cache's size, a full cache and portions of a few characters give the same ids."""
    for name, value in (("CACHE_CHARS", 50), ("CACHE_CHUNK", 4), ("BATCH_CHARS", 10)):
        monkeypatch.setattr(bpe, name, value)
    cut = list(bpe._portions(["abc", "defghij", "k" * 30, "l"]))
    assert [x for part in cut for x in part] == ["abc", "defghij", "k" * 30, "l"] and len(cut) == 3


def test_slices_by_rows_and_bytes():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["a" * n if n else None for n in (5, 0, 40, 3, 3, 3, 3)]), pa.array(range(7))], names=["t", "i"])
    assert [b.num_rows for b in slices(iter([batch, batch.slice(0, 0)]), 3, 10)] == [2, 1, 3, 1]


def test_bpe_documents(spark, odd, empty):
    library = Tokenizer.from_file(PATH)
    rows = odd.select("doc_id", "text").collect()
    got = bpe.encode_documents(odd, PATH).collect()
    assert len(got) == len(rows) and bpe.encode_documents(empty, PATH).count() == 0
    texts = {r.doc_id: r.text or "" for r in rows}
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)


# --- quality


def plain_counts(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_quality_counts():
    rnd = random.Random(4)
    for _ in range(400):
        text = "".join(rnd.choice(["a ", "b ", "é ", "c\n", "a|\n", "#", "\t", " ", "d d "]) for _ in range(rnd.randint(0, 60)))
        assert quality.base_counts(text) == plain_counts(text), repr(text)
    assert quality.base_counts(None) == (0, 0, 0, 0, 0)


def test_repeats_beyond_packed_keys():
    words = [str(i).encode() for i in range(9000)]
    assert quality.repeat_words(words + words[100:105]) == 10


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        ("An ordinary sentence of some length ends here.", False), ("of%%% the*** and$$$ to&&& be###", True), ("RR!! EAUX!! DE!! LA!!", True), ("ALL CAPITAL LETTERS IN HERE", True),
        ("home | about | contact", True), ("Read more", True), ("Copyright 2020. All rights reserved.", True), ("the the the the the the", True), ("Short.", False), ("ÄÖÜ ÀÉÈ ÑÕ", True), ("МОСКВА ГОРОД РЕКА", True),
        ("R&D costs rose.", False), ("You can use cookies in the recipe for dessert.", False), ("We use cookies on this site.", True), ("Terms of use of the word irony vary between authors and schools.", False), ("She showed that we use cookies to lure children.", False), ("Terms of use. Privacy policy. All rights reserved.", True), ("Home About Contact Login", True), ("Copyright 2024 Example Corp", True),
        ("The copyright of 1998 was hers.", False), ("Skip to content", True), ("... ... ... ...", True), ("if (found) { return found; }", True), ("it ended, he said.\"", False),
        ("Home · Politics · Sport", True), ("To be. In.", False), ("More about this.", False), ("A Heading Here", False), (" ".join(f"word{i}" for i in range(26)), False),
    ],
)
def test_line_rules(line, fails):
    raw = line.encode()
    assert quality.line_fails(raw, raw.split()) is fails


def test_unended_lines_among_ended_ones():
    wrapped = "This paragraph was wrapped at a\nwidth that leaves no sign at the\nend of its lines. It ends here.\n\nA Heading Without An End\nAnother line stands here.\nA line without an end here\nOne more line that ends here.\nAnd yet another one does.\nSo does this last one."
    assert quality.clean(wrapped) == (wrapped.replace("A line without an end here\n", ""), 6)
    assert quality.clean("Das Ende fehlt auch ü\nnur hier\nin diesem Text")[1] == 0


#: Prose in several scripts, invented.
PROSE = {
    "arabic": "كان البحر هادئا في ذلك الصباح وكانت السفن الصغيرة تعود الى الميناء بعد ليلة طويلة من العمل. جلس الرجل العجوز قرب الماء ينظر الى الطيور البيضاء وهي تدور فوق الاشرعة. قال لحفيده ان الريح سوف تتغير قبل المساء وان عليهم ان يعودوا الى البيت.",
    "korean": "아침 바다는 조용했고 작은 배들은 긴 밤의 일을 마치고 항구로 돌아오고 있었다. 노인은 물가에 앉아 하얀 새들이 돛 위를 도는 것을 바라보았다. 그는 손자에게 저녁이 되기 전에 바람이 바뀔 것이라고 말했다. 그래서 그들은 서둘러 집으로 돌아갔다.",
    "hindi": "उस सुबह समुद्र शांत था और छोटी नावें रात भर के काम के बाद बंदरगाह पर लौट रही थीं। बूढ़ा आदमी पानी के पास बैठकर सफेद पक्षियों को देख रहा था। उसने अपने पोते से कहा कि शाम से पहले हवा बदल जाएगी और उन्हें घर लौटना होगा।",
    "german": "Am Morgen lag das Meer ruhig vor der Stadt und die kleinen Boote kamen nach langer Nacht in den Hafen zurück. Der alte Mann saß am Wasser und sah den weißen Vögeln zu, die über den Segeln kreisten. Er sagte seinem Enkel, dass der Wind vor dem Abend drehen werde.",
    "english": "In the morning the sea lay quiet before the town and the small boats came back to the harbour after a long night. The old man sat by the water and watched the white birds circle above the sails. He told his grandson that the wind would turn before the evening.",
}
POEM = "The tide has left the shore alone\nand silver falls on every stone\nwhile far away the engines hum\nof ships that promised they would come\n\nThe lamps are lit along the quay\nand someone sings across the sea\na song of rope and salt and rain\nthat nobody will sing again"


@pytest.mark.parametrize("script", sorted(PROSE))
@pytest.mark.parametrize("width", [28, 40, 60])
def test_wrapped_prose_stays(script, width):
    import textwrap

    text = "\n".join(textwrap.wrap(PROSE[script], width, break_long_words=False, break_on_hyphens=False))
    n = len(text.split())
    assert quality.clean(text)[1] <= 0.1 * n


def test_poems_stay():
    assert quality.clean(POEM) == (POEM, 0)


def test_quality_documents(odd, empty, documents):
    got = {r.doc_id: r for r in quality.judge(odd).collect()}
    assert not got[1].kept and not got[2].kept and got[1].base_failed and quality.judge(empty).count() == 0
    kept = {r.doc_id for r in quality.judge(documents).where("kept").collect()}
    assert {r.doc_id for r in quality.keep_good(documents).collect()} == kept and len(kept) > 100


# --- decontamination


def plain_hits(text, items):
    words = decontaminate.normal_words(text)
    hit, found = set(), set()
    for item, body in items:
        w = decontaminate.normal_words(body)
        for a in range(max(1, len(w) - 12) if w else 0):
            part = w[a : a + 13]
            for i in range(len(words) - len(part) + 1):
                if words[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def test_contamination_equals_search(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(12)]
    items = [(str(i), " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 5, 13, 14, 20])))) for i in range(12)] + [("e", ""), ("d", "W1, w2-w3")]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 40))) + " " + rnd.choice(items)[1] for _ in range(80)] + [None, "", "é w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame([*items, (None, "w1"), ("n", None)], "item_id string, text string")
    import hashlib

    for size in (decontaminate.MAX_WINDOWS, 7):
        rows = {r.doc_id: r for r in decontaminate.contamination(docs, bench, size).collect()}
        assert len(rows) == len(texts)
        for i, text in enumerate(texts):
            n, hit, found = plain_hits(text, items)
            r = rows[i]
            assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found)), (size, text)
            assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest() and r.contaminated == (hit > 0 and 20 * hit >= n)
        kept = {r.doc_id for r in decontaminate.keep_uncontaminated(docs, bench, size).collect()}
        assert kept == {i for i, r in rows.items() if not r.contaminated}


def test_contamination_odd(odd, empty, spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(odd, bench).where("contaminated or n_items > 0").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.keep_uncontaminated(odd, bench).columns == odd.columns


@pytest.mark.parametrize("size", [decontaminate.MAX_WINDOWS, 3])
def test_contamination_of_repeated_and_null_ids(spark, size):
    """Rows that share a doc_id, or have none, are judged each by their own text, whatever the test set's size."""
    item = " ".join(f"w{i}" for i in range(20))
    clean, bad = "nothing of it here", f"so {item} it is"
    rows = [(1, clean), (1, bad), (2, clean), (2, clean), (None, bad), (None, clean), (None, bad), (3, None)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, key string")
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    name = lambda i, t: (i is not None, i or 0, t or "")
    found = [((r.doc_id, r.n_words, r.n_hit), r.contaminated) for r in decontaminate.contamination(docs, bench, size).collect()]
    expected = [((i, len((t or "").split()), 20 * (t == bad)), t == bad) for i, t in rows]
    assert sorted(found, key=str) == sorted(expected, key=str)
    kept = decontaminate.keep_uncontaminated(docs, bench, size)
    assert kept.columns == docs.columns
    assert sorted(name(r.doc_id, r.text) for r in kept.collect()) == sorted(name(i, t) for i, t in rows if t != bad)


def test_items_without_an_id_mark_words(spark):
    """Their words are hit, but no item is named; the number of windows in a block changes nothing."""
    leak = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(None, leak), (4, "x1 x2"), (4, "x3 x4"), (5, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a " + leak), (2, "x1 x2 and x3 x4"), (3, "clean"), (None, leak)], "doc_id bigint, text string")
    for size in (500_000, 5, 2, 1):
        got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, bench, size).collect())
        assert got == [(0, 15, 15, 0, True), (1, 16, 15, 0, True), (2, 5, 4, 1, True), (3, 1, 0, 0, False)], size
        assert [r.doc_id for r in decontaminate.keep_uncontaminated(docs, bench, size).collect()] == [3]
    assert [len(b) for b in decontaminate._blocks(iter(range(6)), 3)] == [3, 3] and list(decontaminate._blocks(iter(()), 3)) == [[]]


# --- near duplicates


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return {ids[i]: min(groups[root(i)]) for i in range(len(ids))}


def test_golay_is_complete_within_two_bits():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 1 << 23, 3000)
    keys = lambda v: (lambda o, m, e: [{int(a)} | set(b[c].tolist()) for a, b, c in zip(o, m, e, strict=True)])(*golay.near(v))
    for bits in (1, 2):
        y = x.copy()
        for i in range(x.size):
            for b in rnd.choice(23, bits, replace=False):
                y[i] ^= 1 << int(b)
        assert all(a & b for a, b in zip(keys(x), keys(y), strict=True))
        if bits == 1:
            assert all(int(o) in k for o, k in zip(golay.near(y)[0], keys(x), strict=True))


def test_prints_within_four_bits_share_a_key():
    rnd = random.Random(1)
    x = [rnd.getrandbits(64) for _ in range(2000)]
    y = [a ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for a in x]
    sets = []
    for prints in (x, y):
        keys, owners = simhash.keys_of(np.array(prints, np.uint64))
        own = [set() for _ in prints]
        for k, o in zip(keys.tolist(), owners.tolist(), strict=True):
            own[o].add(k)
        sets.append(own)
    assert all(a & b for a, b in zip(*sets, strict=True))


def test_near_duplicates_equal_all_pairs(documents):
    rows = documents.select("doc_id", "text").collect()
    prints = [plain_print(r.text) for r in rows]
    expected = plain_components(prints, [r.doc_id for r in rows])
    got = simhash.near_duplicates(documents).collect()
    assert {r.doc_id: r.component_id for r in got} == expected and len(got) == len(rows)
    assert {r.doc_id: r.fingerprint for r in got} == {r.doc_id: f"{p:016x}" for r, p in zip(rows, prints, strict=True)}
    assert {r.doc_id for r in simhash.keep_one(documents).collect()} == set(expected.values())


def test_one_row_of_each_group_of_texts(spark):
    """Different texts under one doc_id are no near-duplicates; of a group the smallest doc_id's own copy stays."""
    rnd = random.Random(8)
    a, b, c, d = (" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(60)) for _ in range(4))
    rows = [(5, a), (5, b), (6, b), (5, a), (4, a), (7, c), (7, a), (None, c), (None, c), (None, d), (None, d)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(simhash.keep_one(docs).collect(), key=str)
    assert [(r.doc_id, r.text) for r in got] == sorted([(4, a), (5, b), (7, c), (None, d)], key=lambda r: f"Row(doc_id={r[0]}, text={r[1]!r})")


def test_dense_groups_in_blocks_and_runs(spark):
    rnd = random.Random(6)
    base = [rnd.getrandbits(64) for _ in range(3)]
    prints = {a ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for a in base for _ in range(150)}
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp bigint, root bigint")
    expected = plain_components([p % (1 << 64) for p in prints], list(range(len(prints))))
    for group in (simhash.GROUP, 20):
        found = {r.node: r.component for r in components(simhash.links(table, group=group)).collect()}
        assert {i: found.get(i, i) for i in range(len(prints))} == expected


def test_near_duplicates_odd(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert len(got) == odd.count() and by[1] == by[2].union(by[1]) and {c for _, c in by[3]} == {1} and {c for _, c in by[6]} == {5}
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(odd).collect()]
    assert kept.count(5) == 1 and 6 not in kept and None in kept


def test_links_through_rows_without_an_id(spark, monkeypatch):
    """A chain of three fingerprints whose middle one belongs to a null doc_id is one component; null rows alone have none."""
    prints = [(7, 0x00), (None, 0x0F), (9, 0xFF), (None, 0x3FF << 40), (None, 0x1FF << 40), (3, 0x7F << 20)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    got = simhash.near_duplicates(spark.createDataFrame(prints, "doc_id bigint, fp bigint")).collect()
    assert {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in got} == {
        (7, 0): 7, (None, 0x0F): 7, (9, 0xFF): 7, (None, 0x3FF << 40): None, (None, 0x1FF << 40): None, (3, 0x7F << 20): 3,
    }


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (200, 200)], "u bigint, v bigint")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


# --- language


def test_language_held_out_accuracy(documents):
    rows = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 40 and right >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_odd(odd, empty, spark):
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 4)) and got[8].lang_pred != "und"
    assert langid.identify(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    assert {r.doc_id for r in langid.keep_identified(unlabelled).collect()} == {5, 6, 7, 8, 9, None}


def test_every_label_is_learned(spark):
    rnd, n = random.Random(2), 70
    words = [["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(4)] for _ in range(n)]
    rows = [(d * n + k, " ".join(rnd.choice(words[k]) for _ in range(12)), f"x{k}") for d in range(6) for k in range(n)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert sorted(x for f in model.families for x in f) == sorted(f"x{k}" for k in range(n))
    assert {model.predict(" ".join(words[k] * 3))[0] for k in range(n)} == {f"x{k}" for k in range(n)}


def test_repeated_ids_are_learned_alike(spark, documents):
    """Rows under one doc_id: the same one is learned from, in whatever order they come."""
    rows = [(i % 30, t, lang) for i, (t, lang) in enumerate((r.text, r.lang) for r in documents.where("lang is not null").limit(90).collect())]
    schema = "doc_id bigint, text string, lang string"
    models = [langid.fit(spark.createDataFrame(given, schema).repartition(n)) for given, n in ((rows, 1), (rows[::-1], 3))]
    assert models[0].families == models[1].families and (models[0].family[0] == models[1].family[0]).all()


def test_letter_junk_is_rejected(spark, documents):
    """Random letters and endless words go whatever the duels between languages say; labelled texts held out stay."""
    rnd = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = ["".join(rnd.choice(letters + "    ") for _ in range(n)) for n in (200, 500, 2000, 8000) for _ in range(5)] + ["x" * 2000, "zq " * 900]
    good = quality.keep_good(documents)
    added = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(junk)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in langid.keep_identified(good.select(*added.columns).unionByName(added)).collect()}
    assert not [i for i in kept if i >= 10**9]
    held = [r.doc_id for r in good.where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()]
    assert len(kept & set(held)) >= 0.98 * len(held)


# --- language model, licences, pipeline


def test_language_model_equals_sql(documents, duck):
    duck.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    expected = {r[0]: r for r in duck.sql(lm.SQL).fetchall()}
    got = {r.doc_id: tuple(r) for r in lm.score(documents, block_bytes=50_000, bucket_entries=9_000).collect()}
    assert got == expected
    expected = {r[0]: r for r in duck.sql(lm.sql(3)).fetchall()}
    got = {r.doc_id: tuple(r) for r in lm.score(documents, block_bytes=50_000, bucket_entries=9_000, order=3, group=5).collect()}
    assert got == expected


def plain_backoff(texts, order, alpha=lm.ALPHA):
    """Every document by counting the n-grams of all the others."""
    lists = [[w.decode() for w in lm.words_of((t or "").translate(lm._LOWER))] for t in texts]
    out = []
    for d, words in enumerate(lists):
        rest = [x for i, x in enumerate(lists) if i != d]
        counts = Counter(tuple(x[i : i + k]) for x in rest for k in range(1, order + 1) for i in range(len(x) - k + 1))
        n, total, backed = sum(map(len, rest)), 0.0, 0

        def score(gram):
            if len(gram) == 1:
                return math.log10(counts[gram] / n if counts[gram] else alpha / (n + 1))
            return math.log10(counts[gram] / counts[gram[:-1]]) if counts[gram] else math.log10(alpha) + score(gram[1:])

        for i in range(len(words)):
            gram = tuple(words[max(0, i - order + 1) : i + 1])
            total += score(gram)
            backed += len(gram) > 1 and not counts[gram]
        out.append((len(words), backed, round(total, 4)))
    return out


@pytest.mark.parametrize(("order", "group", "bits"), [(1, 256, 8), (2, 2, 2), (3, 256, 8), (3, 3, 3), (4, 2, 5), (2, 2, 8)])
def test_language_model_by_a_tree_equals_counting(spark, order, group, bits):
    """Blocks of a document or two, summed over several levels: the same totals as from one bucket."""
    rnd = random.Random(order)
    texts = [" ".join(rnd.choice("A a b c d e f g".split()) for _ in range(rnd.randint(0, 30))) for _ in range(40)] + [None, "a b", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    got = {r.doc_id: (r.n_tokens, r.n_backoff, r.log10_score) for r in lm.score(docs, block_bytes=60, bucket_entries=20, group=group, order=order, bits=bits).collect()}
    expected = plain_backoff(texts, order)
    assert [got[i][:2] for i in range(len(texts))] == [e[:2] for e in expected]
    assert all(abs(got[i][2] - e[2]) < 2e-4 for i, e in enumerate(expected))


def test_language_model_rows_grow_with_the_blocks(spark):
    """Twice the documents give about twice the rows at the blocks, whatever the number of buckets; nodes get fewer by level."""
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") + rnd.choice("qrstuvwxyz") for _ in range(100)) for _ in range(80)]
    rows = {}
    for n in (40, 80):
        docs = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id int, text string").coalesce(1)
        cut = lm.blocks(docs, 1)
        made = cut.mapInArrow(lm._of_blocks(2, 2, -(-n // 4)), lm._PIECES)
        rows[n] = made.count(), made.groupBy("path", "grp").count().count()
    assert cut.count() == 80 and rows[80][0] == 2 * rows[40][0] <= 80 * 4 and rows[80][1] <= 4 * 20


def test_language_model_odd(odd, empty):
    got = lm.score(odd).collect()
    assert len(got) == odd.count() and {r.log10_score for r in got if r.n_tokens == 0} == {0.0} and lm.score(empty).count() == 0


def test_licences(spark, odd):
    texts = [
        ("Some text\nLicensed under CC BY-NC 4.0.\nMore.", "CC-BY-NC-4.0"), ("Hello. Released under the MIT\nLicense. x", "MIT"), (None, ""), ("", ""), ("No license here.", ""),
        ("Licensed under the Apache License, Version 2.0. And this work is licensed under the GNU General Public License, version 3", "Apache-2.0"),
        ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!\nThis work is licensed under the GNU General Public License, version 3.", "Apache-2.0,GPL-3.0"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id int, text string")
    assert {r.doc_id: r.licences for r in licences.scan(rows).collect()} == {i: x for i, (_, x) in enumerate(texts)}
    assert licences.scan(odd).count() == odd.count() and licences.scan(odd.limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
APACHE = """   Copyright 2020 The Authors

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS.
"""
GPL = """    A program
    Copyright (C) 2020  Jane Doe

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""


def test_wrapped_standard_texts(spark):
    """Standard files, also as comments, with carriage returns, and without a blank line after the copyright line."""
    full = {MIT: "MIT", APACHE: "Apache-2.0", GPL: "GPL-3.0-or-later", "A title\n\nThis is free and unencumbered software released into the public\ndomain.\n\nAnyone is free": "Unlicense"}
    rows = [(t, name) for t, name in full.items()]
    rows += [("".join(f"# {x}\n" for x in t.split("\n")), name) for t, name in full.items()] + [(t.replace("\n", "\r\n"), name) for t, name in full.items()]
    rows += [(MIT.replace("Jane Doe\n\n", "Jane Doe\n"), "MIT"), (MIT.replace("notice shall", "notice may"), ""), (MIT + "\n" + APACHE, "Apache-2.0,MIT")]
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id int, text string")
    assert {r.doc_id: r.licences for r in licences.scan(table).collect()} == {i: name for i, (_, name) in enumerate(rows)}


BSD3 = """Copyright (c) 2011, Example Org
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the University nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
"""
BSD2 = BSD3[: BSD3.index("3. Neither")] + BSD3[BSD3.index("THIS") :]
ISC = """Copyright (c) 2019 Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
GPL3 = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
LATER = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
APACHE_TERMS = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.
"""


@pytest.mark.parametrize(
    ("text", "name"),
    [
        (BSD3, "BSD-3-Clause"), (BSD2, "BSD-2-Clause"), (BSD3.replace("\n\n1.", "\n1."), "BSD-3-Clause"), ("BSD 2-Clause License\n\n" + BSD3, "BSD-2-Clause,BSD-3-Clause"),
        (ISC, "ISC"), (ISC.replace("and/or", "and"), "ISC"), (ISC.replace(", provided", " if provided"), ""), (MPL, "MPL-2.0"), (MPL.replace("v. 2.0", "v. 1.1"), ""), (GPL3, "GPL-3.0"), (GPL3.replace("29 June", "30 June"), ""),
        (GPL3.replace("GENERAL", "LESSER GENERAL"), "LGPL-3.0"), (LATER, "LGPL-2.1-or-later"), (LATER.replace("either\nversion 2.1 of the License, or (at your option) any later version", "version 2.1 of the License"), "LGPL-2.1-only"),
        (LATER.replace("Lesser General", "General").replace("2.1", "2").replace("library", "program"), "GPL-2.0-or-later"), (LATER.replace("2.1", "2.5"), ""),
        (APACHE_TERMS, "Apache-2.0"), (APACHE_TERMS.replace("2.0, January 2004", "1.1"), ""), (ZLIB, "Zlib"), (ZLIB.replace("no event", "any event"), ""),
        ("# SPDX-License-Identifier: MIT\nimport x", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0-or-later"), ("SPDX-License-Identifier: MITX", ""),
        ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"), ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"), ("Licensed under CC BY-SA 2.0.", ""),
    ],
)
def test_licence_texts_and_near_misses(spark, text, name):
    """Standard texts, written out here; SQL says the same of each."""
    rows = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = licences.scan(rows).collect()
    assert [r.licences for r in found] == [name]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents AS SELECT 1::BIGINT AS doc_id, $1::VARCHAR AS text", [text])
    sql = duck.sql(oracle.LICENCES)
    assert [dict(zip(sql.columns, r, strict=True)) for r in sql.fetchall()] == [r.asDict() for r in found]


def plain_licences(text):
    import re

    normal = re.sub(r"[^a-z0-9.!?\n]+", " ", (text or "").lower())
    sequences = []
    for marked in (re.sub(r"[.!?]* *\n|[.!?]+ ", "|", normal), re.sub(r"[.!?]+ ", "|", re.sub(r" *\n[ \n]*", " ", normal))):
        pieces = [re.sub("[.!?]", "", p).strip(" ") for p in marked.split("|")]
        sequences.append([licences.KNOWN[p] for p in pieces if p in licences.KNOWN])

    def holds(ids, rule):
        rest = iter(ids)
        return all(r in rest for r in rule)

    return ",".join(sorted({name for name, rule in licences.RULES if any(holds(s, rule) for s in sequences)}))


def test_licences_equal_plain_matching(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert {r.doc_id: r.licences for r in licences.scan(documents).collect()} == {i: plain_licences(t) for i, t in texts.items()}


def test_pipeline(spark, documents, odd, empty):
    sf = "/root/testdata/sf0.001"
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "decontamination", "bpe"]
    got = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in got.collect()}
    bad = {r.doc_id for r in decontaminate.contamination(documents, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    good = {r.doc_id for r in quality.judge(documents).where("kept").collect()}
    assert ids and ids <= good - bad
    reread = simhash.near_duplicates(documents.join(got.select("doc_id"), "doc_id"))
    assert reread.count() == len(ids)
    for table in (odd, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == table.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def test_pipeline_equals_plain_reading(spark, documents):
    """Every stage by plain loops over the rows that the one before kept, down to the library's token ids."""
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in documents.collect()}
    texts = {}
    for i, r in rows.items():
        n, _, _, _, repeated = plain_counts(r.text)
        cleaned, lost = quality.clean(r.text)
        if n >= 10 and 100 * repeated <= 20 * n and 2 * lost <= n:
            texts[i] = cleaned if lost else r.text
    schema = "doc_id bigint, text string, lang string"
    model = langid.fit(spark.createDataFrame([(i, t, rows[i].lang) for i, t in texts.items()], schema), floors=True)
    texts = {i: t for i, t in texts.items() if model.identified(t, langid.MIN_SCORE)}
    groups = plain_components([plain_print(t) for t in texts.values()], list(texts))
    texts = {i: texts[i] for i in sorted(set(groups.values()))}
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        words = decontaminate.normal_words(r.text)
        windows |= {tuple(words[a : a + 13]) for a in range(max(1, len(words) - 12) if words else 0)}
    kept = {}
    for i, t in texts.items():
        words, hit = decontaminate.normal_words(t), set()
        for size in {len(w) for w in windows}:
            for a in range(len(words) - size + 1):
                if tuple(words[a : a + size]) in windows:
                    hit.update(range(a, a + size))
        if not hit or 20 * len(hit) < len(words):
            kept[i] = t
    library = Tokenizer.from_file(PATH)
    expected = {i: (ids := library.encode(t, add_special_tokens=False).ids, library.decode(ids, skip_special_tokens=False)) for i, t in kept.items()}
    got = {r.doc_id: (list(r.ids), r.decoded) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == expected and 100 < len(got) < len(rows)


def test_pipeline_leaves_no_tables_of_its_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["decontamination"]
