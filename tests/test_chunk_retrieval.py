import random
import re

import pytest
from pyspark.sql import functions as F

from lexweave.functions import metadata, sparse
from lexweave.operators import chunk, retrieval
from lexweave.plans.rag import answer, search
from lexweave.sources import config, corpus, index
from lexweave.streaming.incremental import follow, read_latest


def loop_windows(n, size, overlap):
    out, at = [], 0
    while True:
        out.append((at, min(at + size, n)))
        if out[-1][1] == n:
            return out
        at = out[-1][1] - overlap


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 472, 473, 2000])
def test_windows(spark, n):
    row = spark.range(1).select(chunk.windows(F.slice(F.sequence(F.lit(0), F.lit(max(n, 1))), F.lit(1), F.lit(n))).alias("w")).first()
    assert [(w[0], w[-1] + 1) if w else (0, 0) for w in row.w] == loop_windows(n, 256, 40)


def test_windows_need_an_overlap_below_the_size():
    with pytest.raises(ValueError):
        chunk.windows(F.lit(None), 10, 10)


def plain_pack(text, size, overlap):
    count = lambda t: len(t.split())
    if count(text) <= size:
        return [text]
    out, held, total = [], [], 0
    for p in [p.strip() for p in text.split("\n\n") if p.strip()]:
        n = count(p)
        if n > size or total + n > size:
            out += ["\n\n".join(held)] if held else []
            held, total = [], 0
        if n > size:
            out += [" ".join(p.split()[a:b]) for a, b in loop_windows(n, size, overlap)]
        else:
            held.append(p)
            total += n
    return out + (["\n\n".join(held)] if held else [])


def test_pack_and_links(spark):
    rnd = random.Random(3)
    texts = ["\n\n".join(" ".join(["w"] * rnd.choice([1, 3, 9, 10, 11, 25])) for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    units = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "semantic_unit_id string, text string")
    rows = {}
    for r in chunk.chunk_units(units, 10, 3).collect():
        rows.setdefault(r.semantic_unit_id, {})[r.child_chunk_index] = r
    for i, t in enumerate(texts):
        got = [rows[f"u{i}"][k] for k in sorted(rows[f"u{i}"])]
        assert [r.page_content for r in got] == plain_pack(t, 10, 3)
        assert [r.next_chunk_id for r in got[:-1]] == [r.chunk_id for r in got[1:]] and [r.prev_chunk_id for r in got[1:]] == [r.chunk_id for r in got[:-1]]
        assert got[0].prev_chunk_id is None and got[-1].next_chunk_id is None and all(r.token_count <= 10 for r in got)


class PlainWords:
    """The stand-in tokenizer in Python."""

    def encode(self, text):
        return re.findall(r"\w+|[^\w\s]", text)

    def decode(self, found):
        return " ".join(found)


def test_any_tokenizer_packs_alike(spark):
    rnd = random.Random(5)
    texts = ["\n\n".join(" ".join(rnd.choice(["w", "x,", "(y)"]) for _ in range(rnd.choice([1, 4, 9, 12, 30]))) for _ in range(rnd.randint(1, 6))) for _ in range(40)] + ["", " \n\n "]
    units = spark.createDataFrame([(f"u{i}", t, 1) for i, t in enumerate(texts)], "semantic_unit_id string, text string, other int")
    columns = ["chunk_id", "page_content", "token_count", "child_chunk_count", "prev_chunk_id", "next_chunk_id", "other"]
    own, given = ({tuple(r) for r in chunk.chunk_units(units, 10, 3, tokenizer=t).select(columns).collect()} for t in (None, PlainWords))
    assert own == given and len(own) > 60


def test_library_tokenizer(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    factory = chunk.library_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    units = spark.createDataFrame([("u", "plain words of a text " * 30)], "semantic_unit_id string, text string")
    rows = chunk.chunk_units(units, 50, 5, tokenizer=factory).orderBy("child_chunk_index").collect()
    ids = factory().encode("plain words of a text " * 30)
    assert len(rows) == len(loop_windows(len(ids), 50, 5)) and rows[0].page_content == factory().decode(ids[:50])


class Failing(index.HashEmbedder):
    def embed(self, texts):
        if any("fail" in t for t in texts):
            raise RuntimeError("no vector")
        return super().embed(texts)


def test_failing_batches_are_counted(spark):
    rows = spark.createDataFrame([(i, "fail" if i == 3 else f"text {i}") for i in range(8)], "id bigint, text string").coalesce(1)
    got = {r.id: r.vector for r in index.embed(rows, Failing, batch=2).collect()}
    assert [i for i, v in sorted(got.items()) if v is None] == [2, 3]


class Counting:
    """A cross-encoder that prefers long texts; a worker makes it once."""

    made = 0

    def __init__(self):
        Counting.made += 1
        assert Counting.made == 1

    def predict(self, pairs):
        return [float(len(t)) for _, t in pairs]


def test_rerank_by_a_model(spark):
    ranked = spark.createDataFrame([(q, i, 1.0, i + 1) for q in range(3) for i in range(6)], "query_id bigint, id bigint, score double, rank int")
    docs = spark.createDataFrame([(i, "x" * (i % 4)) for i in range(6)], "id bigint, text string")
    queries = spark.createDataFrame([(q, "ask") for q in range(3)], "query_id bigint, query string")
    got = retrieval.rerank(ranked, queries, docs, 2, retrieval.model_scorer(Counting, 4)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.score) for r in got] == [(q, i, s) for q in range(3) for i, s in ((3, 3.0), (2, 2.0))]


def test_dense_ties_over_batches(spark):
    """Equal scores go to smaller ids, whatever batch they come in."""
    rnd = random.Random(2)
    vectors = [[float(rnd.randint(0, 1)) for _ in range(3)] for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id bigint, vector array<float>").repartition(3)
    asked = rows.where("id < 5").withColumnRenamed("id", "query_id")

    def cosine(a, b):
        norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / max(norm, 1e-300), 6)

    got = {}
    for r in retrieval.dense_top_k(asked, rows, 7).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.id
    for q in range(5):
        best = sorted(range(400), key=lambda i: (-cosine(vectors[q], vectors[i]), i))[:7]
        assert [got[q][k + 1] for k in range(7)] == best


def test_segments_replace_chunks(spark, tmp_path):
    """A document that comes again takes the place of its chunks; searches and weights see live ones only."""
    path, schema = str(tmp_path / "index"), "source string, markdown string"
    old = spark.createDataFrame([("a.txt", "apples are red"), ("b.txt", "pears are green")], schema)
    assert index.build_index(old, path) == (2, 0)
    new = spark.createDataFrame([("a.txt", "plums are blue"), ("c.txt", "grapes are white")], schema)
    assert index.upsert_index(new, path) == (2, 0)
    opened = index.open_index(spark, path)
    live = {r.source: r.page_content for r in opened["chunks"].collect()}
    assert live == {"a.txt": "plums are blue", "b.txt": "pears are green", "c.txt": "grapes are white"}
    ids = {r.id for r in opened["chunks"].collect()}
    assert len(ids) == 3 and {r.id for r in opened["postings"].select("id").distinct().collect()} == ids == {r.id for r in opened["dense"].collect()}
    assert opened["idf"].agg(F.max("df")).first()[0] == 3
    asked = spark.createDataFrame([(0, "red apples plums")], "query_id bigint, query string")
    assert [r.id for r in search(asked, opened, config.Config(method="bm25", rerank=False)).collect()] == ["a|unit|1|chunk|1"]
    assert index.upsert_index(new, path) == (2, 0) and index.open_index(spark, path)["chunks"].count() == 3


def test_first_documents_are_chosen_by_name(spark):
    files = spark.createDataFrame([("b", b"2"), ("a", b"1"), ("c", b"3")], "source string, content binary")
    assert sorted(r.source for r in corpus.first_documents(files, 2).collect()) == ["a", "b"]
    assert corpus.first_documents(files, None).count() == 3


def test_colliding_buckets_sum(spark):
    rows = sparse.postings(spark.createDataFrame([(1, "a a b")], "doc_id int, text string"), buckets=1).collect()
    assert [(r.bucket, round(r.weight, 6)) for r in rows] == [(0, round(1 + 0.6931471805599453 + 1, 6))]
    blake = sparse.postings(spark.createDataFrame([(1, "Ab")], "doc_id int, text string"), mode="blake2b").collect()
    import hashlib

    assert blake[0].bucket == int.from_bytes(hashlib.blake2b(b"ab", digest_size=8).digest(), "big") % 2**20
    with pytest.raises(ValueError):
        sparse.postings(spark.range(1), mode="x")


@pytest.mark.parametrize("mode", sparse.HASH_MODES)
def test_postings_equal_counting(spark, mode):
    """Counts and collisions in rows of their own, also for repeated ids, nulls and texts without tokens."""
    import hashlib
    import math

    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("a B c d e-f g1 ä".split()) for _ in range(rnd.randint(0, 25))) for _ in range(30)] + [None, "", "!!"]
    rows = spark.createDataFrame([(i % 20, t) for i, t in enumerate(texts)], "doc_id int, text string")
    hashed = {"md5": lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16), "blake2b": lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")}[mode]
    expected = []
    for i, t in enumerate(texts):
        found, buckets = re.findall("[a-z0-9]+", (t or "").lower()), {}
        for x in set(found):
            buckets[hashed(x) % 5] = buckets.get(hashed(x) % 5, 0) + 1 + math.log(found.count(x))
        expected += [(i % 20, b, round(w, 6)) for b, w in buckets.items()]
    got = [(r.id, r.bucket, round(r.weight, 6)) for r in sparse.postings(rows, buckets=5, mode=mode).collect()]
    assert sorted(got) == sorted(expected)


def test_fusion_ties_and_empty_lists(spark):
    schema = "query_id bigint, id bigint, score double, rank int"
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], schema)
    b = spark.createDataFrame([(1, 12, 5.0, 1), (1, 10, 4.0, 2)], schema)
    got = [(r.id, r.rank) for r in retrieval.rrf([a, b]).orderBy("rank").collect()]
    assert got == [(10, 1), (12, 2), (11, 3)]
    assert [r.id for r in retrieval.rrf([a, b.limit(0)]).orderBy("rank").collect()] == [10, 11]
    with pytest.raises(ValueError):
        retrieval.retrieve("other", lambda: a, lambda: b)


def test_dense_in_blocks(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(50)]
    vectors = spark.createDataFrame([*rows, (99, None)], "id bigint, vector array<float>")
    asked = vectors.where("id < 7").withColumnRenamed("id", "query_id")
    one = sorted(map(tuple, retrieval.dense_top_k(asked, vectors, 3).collect()))
    assert one == sorted(map(tuple, retrieval.dense_top_k(asked, vectors, 3, block=2).collect())) and len(one) == 21
    assert retrieval.dense_top_k(asked.limit(0), vectors).count() == 0


def test_companies(spark):
    text = "Acme Web, Inc., and Beta LLC, made with ACME WEB Inc, and First National Association, WHEREAS x\nWHEREAS Other Corp, y"
    got = spark.createDataFrame([(text,)], "t string").select(metadata.intro_companies(F.col("t"))).first()[0]
    assert got == ["Acme Web, Inc", "Beta LLC"]
    paths = ["x/full_contract_pdf/Part_I/Type/CreditcardscomInc_20070810_S-1.pdf", "full_contract_pdf/a.PDF", "b.v1.pdf"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    found = rows.select(metadata.company_from_file(F.col("p")).alias("c"), *[c.alias(n) for n, c in metadata.path_metadata(F.col("p")).items()]).collect()
    assert [(r.c, r.document_id, r.part, r.contract_type) for r in found] == [
        ("Creditcardscom  Inc", "CreditcardscomInc_20070810_S-1", "Part_I", "Type"), ("a", "a", "a.PDF", None), (None, "b.v1", None, None)
    ]


def test_index_and_answer(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.TXT").write_text("1. Payment\nThe buyer pays the seller.\n2. Term\nThe term is a year.")
    (tmp_path / "in/deep/b.txt").write_text("plain words on weather")
    (tmp_path / "in/c.md").write_text("not this")
    files = corpus.list_files(spark, str(tmp_path / "in"), ".txt")
    assert sorted(r.source for r in files.select("source").collect()) == ["a.TXT", "deep/b.txt"]
    raw = corpus.extract(corpus.first_documents(files, 5), corpus.text_extractor)
    path = str(tmp_path / "index")
    assert index.build_index(raw, path) == (3, 0)
    opened = index.open_index(spark, path)
    asked = spark.createDataFrame([(0, "when does the buyer pay the seller")], "query_id bigint, query string")
    for method in retrieval.METHODS:
        found = search(asked, opened, config.Config(method=method)).orderBy("rank").collect()
        assert found and (method == "vector" or found[0].id.startswith("a|unit|1"))
    assert index.decode_hits(search(asked, opened), opened["chunks"]).first().page_content
    assert "buyer pays" in answer(asked, opened, generate=lambda ps: ["ok"] * len(ps)).first().prompt
    follow(spark, str(tmp_path / "in"), str(tmp_path / "stream"), str(tmp_path / "state")).awaitTermination()
    assert read_latest(spark, str(tmp_path / "stream")).count() >= 3


def test_config(tmp_path):
    assert config.load_config().k_dense == 10
    (tmp_path / "c.yaml").write_text("k_dense: 4\n")
    assert config.load_config(str(tmp_path / "c.yaml")).k_dense == 4
    (tmp_path / "d.yaml").write_text("nope: 4\n")
    with pytest.raises(ValueError):
        config.load_config(str(tmp_path / "d.yaml"))
