import json
import re

import pytest
from pyspark.sql import functions as F

from bulaq import cli
from bulaq.functions import text as X
from bulaq.functions import vectors as V
from bulaq.operators import embed, enrich, evaluate, remote, search, store
from bulaq.plans import progress, queries
from bulaq.plans.engine import Engine
from bulaq.plans.present import Presenter
from bulaq.sources import export, load
from bulaq.streaming.ingest import index_stream

CORPUS = [
    {"doc_id": "d1", "domain": "legal", "title": "Konstitusiya", "published_at": "2026-04-03", "source": "s", "text": "Maddə 29. Mülkiyyət hüququ\nHər kəsin mülkiyyət hüququ vardır və qanunla qorunur."},
    {"id": "d2", "content": "Bakı. 15 iyun.\nXəzər dənizinin sahilində yerləşən Bakı şəhərində yeni park açılıb.", "domain": "news"},
    {"id": 0, "text": "Азәрбајҹан тарихи чох гәдимдир вә зәнҝиндир, бурада јазылыб.", "metadata": {"court": "x"}},
]


@pytest.fixture
def corpus(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in CORPUS) + "\n\n", "utf-8")
    return load.load_documents(spark, str(p))


def test_load(spark, corpus, tmp_path):
    got = {r["doc_id"]: r for r in corpus.collect()}
    assert sorted(got) == ["0", "d1", "d2"] and got["d1"]["date"] == "2026-04-03" and got["d1"]["extra"] == {"source": "s"} and got["0"]["domain"] == "general"
    (tmp_path / "t/sub").mkdir(parents=True)
    (tmp_path / "t/sub/şə x.txt").write_text("mətn\n2", "utf-8")
    assert [(r["doc_id"], r["text"]) for r in load.load_documents(spark, str(tmp_path / "t")).collect()] == [("şə x", "mətn\n2")]
    assert load.load_documents(spark, (tmp_path / "t").as_uri()).count() == 1  # a folder by its address
    (tmp_path / "bad.json").write_text('[{"text": "x"}]')
    with pytest.raises(Exception, match="doc_id"):
        load.load_documents(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(ValueError, match="register_format"):
        load.load_documents(spark, str(tmp_path / "x.xml"))
    with pytest.raises(KeyError, match="Options"):
        load.keys(load.DOCUMENT_FIELDS, {"body_text": "x"})
    (tmp_path / "f.json").write_text('[{"article_no": "A-17", "issued_on": "2026-01-05", "body": "b", "court": "k"}]')
    r = load.load_documents(spark, str(tmp_path / "f.json"), field_map={"doc_id": "article_no", "date": ["issued_on"]}).first()
    assert (r["doc_id"], r["date"], r["extra"]) == ("A-17", "2026-01-05", {"court": "k"})


def test_own_formats(spark, tmp_path):
    """Readers, writers and stores of the caller, by name."""
    (tmp_path / "a.tsv").write_text("1\tBir mətn\n2\tİki", "utf-8")
    load.register_format("tsv", lambda s, path: s.read.option("sep", "\t").schema("id string, body string").csv(path))
    export.register_export(".txt", lambda rows, path: path.write_text("; ".join(r["a"] for r in rows)))
    try:
        assert [(r["doc_id"], r["text"]) for r in load.load_documents(spark, str(tmp_path / "a.tsv")).orderBy("doc_id").collect()] == [("1", "Bir mətn"), ("2", "İki")]
        assert export.export([{"a": "x"}, {"a": "y"}], tmp_path / "o.txt").read_text() == "x; y"
    finally:
        load.formats._of.pop(".tsv"), export.writers._of.pop(".txt")
    store.stores.register("own", lambda spark, path, namespace, dimension, embedder, flag=0: (path, namespace, dimension, embedder, flag))
    assert Engine(spark, "p", backend="own", backend_options={"flag": 1}).store == ("p", "default", 256, "hashed-256", 1)
    store.stores._of.pop("own")
    with pytest.raises(TypeError, match="chunker"):
        Engine(spark, "p", chunker=3)


def test_queries(spark, tmp_path, corpus):
    q = [{"query_id": "q1", "question": "a", "source_doc_ids": ["d1"]}, {"id": "q2", "query": "b", "relevant_ids": ["d1"], "answerable": False}, {"id": "q3", "query": "c", "relevant_ids": ["missing"]}]
    q += [{"id": "q4", "query": "d", "source_doc_ids": None}, {"id": "q5", "query": "e", "relevant_ids": ["", None]}]
    (tmp_path / "q.json").write_text(json.dumps(q))
    one = spark.createDataFrame([("a", "x", None), ("b", "y", "d1")], "query_id string, query string, relevant_ids string")
    assert [r["query_id"] for r in load.queries_of(one).collect()] == ["b"]
    assert sorted(r["query_id"] for r in load.load_queries(spark, str(tmp_path / "q.json")).collect()) == ["q1", "q3"]
    assert [(r["query_id"], r["domain"]) for r in load.load_queries(spark, str(tmp_path / "q.json"), corpus).collect()] == [("q1", "legal")]


def test_engine(spark, corpus, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), default_year=2026)
    n = e.add_documents(corpus)
    assert n == e.count() == 3 and e.add_documents(corpus) == 0
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    other = corpus.withColumn("doc_id", F.concat(F.lit("new"), "doc_id"))
    assert not re.search("Exchange|Join", plan(e._missing(e.chunks(other), other)))  # new documents: nothing to join
    assert "BroadcastHashJoin" in plan(e._missing(e.chunks(corpus), corpus))
    twice = corpus.where("doc_id = 'd1'").select("doc_id", F.concat(F.lit("Əvvəl. "), "text").alias("text"), "domain", "title", "date", "extra").union(corpus.where("doc_id = 'd1'"))
    e9 = Engine(spark, str(tmp_path / "twice"))
    assert e9.add_documents(twice) == e9.count() == e9.store.scan().select("chunk_id").distinct().count()
    top = e.search("mülkiyyət hüququ", 2).collect()
    assert top[0]["doc_id"] == "d1" and [r["rank"] for r in top] == [1, 2] and top[0]["score"] >= top[1]["score"] and "embedding_text" not in top[0]["metadata"]
    assert [r["doc_id"] for r in e.search("Bakı", 5, {"domain": "news"}).collect()] == ["d2"]
    assert [r["doc_id"] for r in e.search("Bakı", 5, {"court": "x"}).collect()] == ["0"]
    news = e.search("park", 5, {"domain": "news"}).first()
    assert news["metadata"]["date"] == "2026-06-15"
    assert "Azərbaycan tarixi" in e.search("tarix", 1, {"domain": "general"}).first()["text"]
    q = spark.createDataFrame([("q1", "mülkiyyət hüququ", ["d1"], "legal"), ("q2", "Xəzər dənizi Bakı", ["d2"], None)], "query_id string, query string, relevant_ids array<string>, domain string")
    rep = e.evaluate(q, 3)
    assert rep["aggregate"]["recall"] == 1.0 and set(rep["per_domain"]) == {"legal", "unknown"} and "| all |" in evaluate.markdown(rep)
    e.save(str(tmp_path / "saved"))
    e.save_json(str(tmp_path / "saved.json"))
    for other, path in (("a", "saved"), ("b", "saved.json")):
        e2 = Engine(spark, str(tmp_path / other))
        e2.add_texts(["Bu mətn silinəcək, çünki yükləmə köhnəni əvəz edir."])
        e2.load(str(tmp_path / path))  # replaces what was there
        assert e2.count() == 3 and e2.search("mülkiyyət hüququ", 1).first()["doc_id"] == "d1"
        assert [r["doc_id"] for r in e2.search("Bakı", 5, {"court": "x"}).collect()] == ["0"]  # own keys come back
        assert sorted(map(str, e2.store.scan().drop("part_domain").collect())) == sorted(map(str, e.store.scan().drop("part_domain").collect()))
    folder = e.export_chunks(str(tmp_path / "o.jsonl"), distributed=True)
    assert spark.read.json(folder).count() == 3 and sorted(spark.read.json(folder).columns) == sorted(e.store.chunks().columns)
    for kind in ("csv", "md", "parquet"):
        assert spark.read.text(e.export_chunks(str(tmp_path / f"o_{kind}"), kind, True)).count() > 0 if kind != "parquet" else spark.read.parquet(e.export_chunks(str(tmp_path / "o_p"), kind, True)).count() == 3
    assert e.export_chunks(str(tmp_path / "o.csv")).read_bytes()[:3] == b"\xef\xbb\xbf"
    assert e.add_documents(corpus, skip_existing=False) == 3 and e.count() == 3
    e.store.clear()
    assert e.count() == 0


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "Birinci mətn burada yazılıb.", "general")], "doc_id string, text string, domain string").write.parquet(str(src))
    e = Engine(spark, str(tmp_path / "s"))
    for _ in range(2):
        q = index_stream(spark.readStream.schema("doc_id string, text string, domain string").parquet(str(src)), e, str(tmp_path / "cp"))
        q.awaitTermination()
    assert e.count() == 1


def test_enricher_batches_and_progress(spark, corpus, capsys):
    sizes = []

    class Counting(embed.Hashed):
        def vectors(self, texts, query=False):
            if len(texts) > 2:
                raise ValueError("too many at once")
            return super().vectors(texts, query)

    def enricher(chunks):
        return enrich.enrich(chunks, False).withColumn("extra", F.create_map(F.lit("own"), F.lit("yes")))

    e = Engine(spark, backend="memory", embedder=Counting(64), enricher=enricher)
    docs = load.from_texts(spark, [f"Mətn nömrə {i} burada yazılıb və kifayət qədər uzundur." for i in range(9)])
    assert e.add_documents(docs.coalesce(1), batch_size=2, progress=True) == 9 and not sizes
    assert "Indexing" in capsys.readouterr().err
    hit = e.search("nömrə 3", 1).first()
    assert hit["metadata"]["own"] == "yes" and e.store.scan().first()["embedding_text"] == e.store.scan().first()["text"]
    rep = e.evaluate(spark.createDataFrame([("q", "nömrə 3", [hit["doc_id"]], None)], "query_id string, query string, relevant_ids array<string>, domain string"), 3, latencies=1)
    assert rep["latency_ms_p50"] > 0 and "p50" in evaluate.markdown(rep)


def test_progress_bar():
    import io

    out = io.StringIO()
    assert list(progress.track(iter(range(20)), "Phase", out)) == list(range(20))
    lines = out.getvalue().splitlines()
    assert len(lines) == 11 and lines[-1].startswith("Phase") and "20/20  100%" in lines[-1] and "░" not in lines[-1]
    tty = io.StringIO()
    tty.isatty = lambda: True
    bar = progress.ProgressBar("x", 2, 4, tty)
    bar.update(extra="first")
    bar.update()
    bar.finish()
    assert tty.getvalue().startswith("\r") and tty.getvalue().endswith("\n") and "first" in tty.getvalue()


def test_store_versions(spark, tmp_path):
    """Two writers lose nothing, old parts go, many parts become one, and a filter on the domain reads its folder only."""
    def rows(i, n=2):
        base = spark.createDataFrame([(f"{i}::{j:04d}", str(i), "t", 0, 1) for j in range(n)], "chunk_id string, doc_id string, text string, start int, end int")
        meta = spark.createDataFrame([], store.SCHEMA).schema["meta"].dataType
        struct = F.struct(*[(F.lit(["a", "b"][i % 2]) if f.name == "domain" else F.lit(None).cast(f.dataType)).alias(f.name) for f in meta])
        return base.withColumn("meta", struct).withColumn("extra", F.create_map().cast("map<string,string>")).withColumn("embedding_text", F.lit("t")).withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))

    a, b = (store.ParquetStore(spark, str(tmp_path), dimension=2) for _ in range(2))
    a.COMPACT = b.COMPACT = 3
    assert a.count() == 0 and a.add_new(rows(0)) == 2
    number, parts = a.current()
    first = b._write(rows(1))
    assert b._publish(number + 1, [*parts, first]) and not a._publish(number + 1, parts)  # the number is taken
    a.add_new(rows(2))
    assert a.count() == b.count() == 6
    for i in range(3, 8):
        b.add_new(rows(i))
    assert b.count() == 16 and len(b.current()[1]) <= 3 and len(b._names("version=")) <= b.KEPT and len(b._names("part=")) <= 9
    only = search.where(a.scan(), {"domain": "b"})
    assert only.count() == 8 and all("part_domain=b" in f for f in only.inputFiles() if "part_domain" in f and "=a" not in f)
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part_domain", plan)
    b.COMPACT = 10
    for _ in range(2):
        old = set(b.current()[1])
        b.upsert(rows(1).withColumn("text", F.lit("new")))
        assert b.count() == 16 and b.scan().where("text = 'new'").count() == 2
    assert len(old & set(b.current()[1])) >= 1  # parts without these ids stay as they are
    b.upsert(rows(20).union(rows(20)))
    assert b.count() == 18
    with pytest.raises(Exception, match="numbers"):
        a.add_new(rows(9).withColumn("vector", F.array(F.lit(1.0))))
    b.clear()
    assert a.count() == 0


class StubClient:
    """A server in a folder: what the tasks of several processes write there is seen by all."""

    def __init__(self, folder):
        self.folder = folder

    def _all(self):
        return {p.stem.replace("~", ":"): json.loads(p.read_text()) for p in self.folder.glob("*.row")}

    def dimension(self):
        p = self.folder / "dim"
        return int(p.read_text()) if p.exists() else None

    def create(self, dimension):
        (self.folder / "dim").write_text(str(dimension))

    def upsert(self, rows):
        flag = self.folder / f"failed-{rows[0]['id'].replace(':', '~')}"
        if not flag.exists():  # each first batch fails once
            flag.write_text("")
            raise OSError("503 service unavailable")
        assert len(rows) <= 2
        for r in rows:
            assert all(isinstance(v, (str, int, float, bool)) for v in r["metadata"].values())
            (self.folder / f"{r['id'].replace(':', '~')}.row").write_text(json.dumps(r))

    def query(self, vector, k, equal):
        hits = [(r["id"], sum(a * b for a, b in zip(r["values"], vector)), r["metadata"]) for r in self._all().values() if all(r["metadata"].get(n) == v for n, v in (equal or {}).items())]
        return sorted(hits, key=lambda h: (-h[1], h[0]))[:k]

    def ids(self):
        ids = sorted(self._all())
        for i in range(0, len(ids), 2):
            yield ids[i : i + 2]

    def fetch(self, ids):
        return {i: (r["values"], r["metadata"]) for i, r in self._all().items() if i in ids}

    def count(self):
        return len(self._all())

    def clear(self):
        for p in self.folder.glob("*.row"):
            p.unlink()


def test_remote_store(spark, corpus, tmp_path):
    connect = lambda folder=tmp_path: StubClient(folder)
    with pytest.raises(ValueError, match="dimension"):
        remote.RemoteStore(spark, connect)
    at = remote.RemoteStore(spark, connect, 256, batch=2, wait=0.01)
    with pytest.raises(ValueError, match="256"):
        remote.RemoteStore(spark, connect, 8)
    e = Engine(spark, backend=at, default_year=2026)
    assert e.add_documents(corpus) == 3 and e.add_documents(corpus) == 0 and e.count() == 3
    local = Engine(spark, backend="memory", default_year=2026)
    local.add_documents(corpus)
    for where in (None, {"domain": "news"}, {"court": "x"}):
        one, two = (x.search("mülkiyyət hüququ", 2, where).select("rank", "chunk_id", "doc_id", "text", F.round("score", 9)).collect() for x in (e, local))
        assert one == two
    order = lambda x: sorted(map(str, x.store.scan().select("chunk_id", "doc_id", "text", "start", "end", "meta", "extra", "embedding_text").collect()))
    assert order(e) == order(local)
    assert sorted(r["chunk_id"] for r in at.existing(spark.createDataFrame([("d1::0000",), ("no",)], "chunk_id string")).collect()) == ["d1::0000"]
    assert e.add_documents(corpus, skip_existing=False) == 3 and e.count() == 3
    e.store.clear()
    assert e.count() == 0


def test_remote_clients():
    """The requests that the adapters make of the libraries, which are not installed here."""
    calls = []

    class Index:
        def __getattr__(self, name):
            def call(**o):
                calls.append((name, o))
                return {
                    "query": {"matches": [{"id": "a", "score": 0.5, "metadata": {"text": "t"}}]}, "list": [["a"], [{"id": "b"}]], "fetch": {"vectors": {"a": {"values": [1.0], "metadata": {}}}},
                    "describe_index_stats": {"namespaces": {"n": {"vector_count": 7}}}, "get": {"ids": ["a"], "embeddings": [[1.0]], "documents": ["t"], "metadatas": [{"d": 1}]}, "count": 3,
                }.get(name)

            return call

    p = remote.Pinecone.__new__(remote.Pinecone)
    p.namespace, p.index, p.metric, p.place = "n", "i", "cosine", ("aws", "r")
    p.lib = type("L", (), {"ServerlessSpec": staticmethod(lambda **o: o)})
    p.api = type("A", (), {"Index": lambda self, n: Index(), "list_indexes": lambda self: [{"name": "i", "dimension": 4}], "create_index": lambda self, **o: calls.append(("create", o))})()
    assert p.dimension() == 4 and p.query([1.0], 2, {"x": 1}) == [("a", 0.5, {"text": "t"})] and list(p.ids()) == [["a"], ["b"]] and p.fetch(["a"]) == {"a": ([1.0], {})} and p.count() == 7
    p.create(4), p.upsert([{"id": "a"}]), p.clear()
    sent = dict(calls)
    assert sent["query"]["filter"] == {"x": {"$eq": 1}} and sent["upsert"]["namespace"] == "n" and sent["delete"]["delete_all"] and sent["create"]["dimension"] == 4
    calls.clear()
    c = remote.Chroma.__new__(remote.Chroma)
    c.at = Index()
    assert c.dimension() == 1 and c.fetch(["a"]) == {"a": ([1.0], {"d": 1, "text": "t"})}
    c.upsert([{"id": "a", "values": [1.0], "metadata": {"text": "t", "d": 1}}])
    assert dict(calls)["upsert"] == {"ids": ["a"], "embeddings": [[1.0]], "documents": ["t"], "metadatas": [{"d": 1}]}


def test_judged_is_the_same_as_arrays(spark):
    import random

    r = random.Random(5)
    hits, gold, queries = [], [], []
    for q in range(30):
        rel = sorted({r.choice(["d1", "d2", "d1::0000", "d2::0001", "z"]) for _ in range(r.randint(0, 4))})
        queries.append((str(q), rel, r.choice(["a", None])))
        gold += [(str(q), x) for x in rel]
        for rank in range(1, r.randint(1, 7)):
            d = r.choice(["d1", "d2", "d3"])
            hits.append((str(q), rank, f"{d}::{r.randrange(2):04d}", r.choice([d, None])))
    hits = spark.createDataFrame(hits, "query_id string, rank int, chunk_id string, doc_id string").dropDuplicates(["query_id", "chunk_id"])
    queries = spark.createDataFrame(queries, "query_id string, relevant_ids array<string>, domain string")
    gold = spark.createDataFrame(gold, "query_id string, relevant_id string")
    for k in (1, 3, 5):
        a, b = evaluate.per_query(evaluate.hit_ids(hits, queries), k), evaluate.judged(hits, gold, queries, k)
        show = lambda x: sorted((r["query_id"], r["domain"], round(r["rr"], 9), round(r["recall"], 9), round(r["ndcg"], 9)) for r in x.collect())
        assert show(a) == show(b)


def test_top_k_ways_agree(spark):
    import random

    r = random.Random(2)
    vec = lambda: [float(r.randint(-3, 3)) for _ in range(4)]  # noqa: E731  (many ties)
    s = spark.createDataFrame([(i, vec()) for i in range(60)], "chunk_id bigint, vector array<double>")
    q = spark.createDataFrame([(i, vec()) for i in range(9)], "query_id bigint, query_vector array<double>")
    a = sorted(map(tuple, search.top_k(s, q, 4).collect()))
    assert a == sorted(map(tuple, search.top_k(s, q, 4, query_bytes=64).collect())) and len(a) == 36
    dot = lambda x, y: round(sum(i * j for i, j in zip(x, y)), 12)
    rows, asked = s.collect(), q.collect()
    want = [(x["query_id"], *t) for x in asked for t in [(v, score, i) for i, (score, v) in enumerate(sorted(((dot(y["vector"], x["query_vector"]), y["chunk_id"]) for y in rows), key=lambda t: (-t[0], t[1]))[:4], 1)]]
    assert a == sorted(want)
    held = search.HELD_ROWS
    search.HELD_ROWS = 1
    assert a == sorted(map(tuple, search.top_k(s.repartition(3), q, 4).collect()))
    search.HELD_ROWS = held
    one = q.first()
    assert [x[1:] for x in a if x[0] == one["query_id"]] == sorted(map(tuple, search.nearest(s, one["query_vector"], 4).collect()), key=lambda t: t[0]) or {x[1] for x in a if x[0] == 0} == {t[0] for t in search.nearest(s, one["query_vector"], 4).collect()}
    with pytest.raises(Exception, match="different sizes"):
        search.top_k(s, spark.createDataFrame([(1, [1.0])], q.schema), 2).collect()


def test_metrics(spark):
    df = spark.createDataFrame([(["x", "g", "y"], ["g"]), (["a"], ["z"]), (["a", "b", "c"], ["a", "z"]), ([], ["g"])], "r array<string>, g array<string>")
    got = df.select(V.reciprocal_rank(F.col("r"), F.col("g")).alias("rr"), V.recall(F.col("r"), F.col("g"), 3).alias("rec"), V.ndcg(F.col("r"), F.col("g"), 3).alias("n")).collect()
    assert [x["rr"] for x in got] == [0.5, 0.0, 1.0, 0.0] and [x["rec"] for x in got] == [1.0, 0.0, 0.5, 0.0]
    assert abs(got[0]["n"] - 0.6309297) < 1e-6 and 0 < got[2]["n"] < 1


def test_embedders():
    import hashlib
    import math
    import random

    r = random.Random(4)
    texts = ["salam dünya", "", "İI", "a", "ab", "😀😀😀 Ə"] + ["".join(r.choice("abcçəİI 😀\n") for _ in range(r.randint(0, 60))) for _ in range(100)]

    def plain(t, dim):
        t, v = " " + t.replace("İ", "i").replace("I", "ı").lower() + " ", [0.0] * dim
        for n in (3, 4, 5):
            for i in range(len(t) - n + 1):
                d = hashlib.blake2b(t[i : i + n].encode(), digest_size=8).digest()
                v[int.from_bytes(d[:4], "little") % dim] += 1.0 if d[4] & 1 else -1.0
        return embed.unit([math.copysign(math.log1p(abs(x)), x) for x in v])

    for dim in (64, 256):
        v = embed.Hashed(dim).vectors(texts)
        assert len(v) == len(texts) and all(abs(a - b) < 1e-12 for t, x in zip(texts, v) for a, b in zip(plain(t, dim), x))
    asked = {}

    class Sent(embed.OpenAI):
        def send(self, payload):
            asked.update(payload)
            return {"data": [{"index": 0, "embedding": [1.0]}]}

    Sent(dim=99, api_key="k").vectors(["x"])
    assert asked["dimensions"] == 99 and asked["encoding_format"] == "float"
    with pytest.raises(ValueError):
        embed.embedders.create("openai", api_key=None)

    class Fake(embed.Rest):
        key_name = "NONE"

        def send(self, payload):
            if len(payload["input"]) > 2:
                raise embed.urllib.error.HTTPError("u", 413, "too large", None, None)
            return {"data": [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in reversed(list(enumerate(payload["input"])))]}

    assert Fake("m", 2, api_key="k").vectors(["a", "bb", "ccc", "", "e"]) == [[1.0, 0.0]] * 5


def test_store_helpers(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("connection reset by peer")
        return 7

    assert store.retried(flaky, sleep=lambda s: None) == 7
    with pytest.raises(ConnectionError, match="resumes"):
        store.retried(lambda: (_ for _ in ()).throw(OSError("timed out")), 2, sleep=lambda s: None)
    with pytest.raises(KeyError):
        store.retried(lambda: {}["x"])
    assert store.scalar_metadata({"a": None, "b": [1], "c": 1}) == {"b": "[1]", "c": 1}


def test_export_and_present(tmp_path):
    assert json.loads(export.export([{"a": {"z", "b"}, "t": (1, 2)}], tmp_path / "x.json").read_text()) == [{"a": ["b", "z"], "t": [1, 2]}]
    assert export.export([{"a": "x|y\nz", "b": "q" * 200}], tmp_path / "x.md").read_text().endswith("q…  |\n".replace("  ", " "))
    assert export.export([], tmp_path / "e.jsonl").read_text() == ""
    with pytest.raises(ValueError):
        export.export([], tmp_path / "x.bin")
    rows = [{"a": 1, "b": {"x": "ş"}}, {"c": None, "a": "q,\"r\""}]
    assert export.export(rows, tmp_path / "x.csv").read_bytes().decode("utf-8") == '\ufeffa,b,c\r\n1,"{""x"": ""ş""}",\r\n"q,""r""",,\r\n'
    assert export.export(rows, tmp_path / "y.md").read_text().split("\n")[:3] == ["| a | b | c |", "| --- | --- | --- |", '| 1 | {"x": "ş"} |  |']
    assert json.loads(export.export(rows, tmp_path / "z.json").read_text()) == rows and export.export([], tmp_path / "n.json").read_text() == "[]"
    with pytest.raises(TypeError, match="Cannot export"):
        export.export([1], tmp_path / "y.json")
    r = [{"rank": i, "score": 0.5, "doc_id": d, "chunk_id": f"{d}::0000", "text": "söz " * 100, "metadata": {"section_heading": "H"}} for i, d in ((1, "a"), (2, "b"), (3, "c"))]
    out = Presenter().render("sual", r, {"b"})
    assert out.startswith("Q: sual\n") and "  CAVAB #1" in out and "  HIT   #2" in out and "score=0.5000" in out and "[H]" in out and "…" in out
    table = Presenter(style="markdown", metadata_fields=["section_heading"]).render("", r).split("\n")
    assert table[0] == "|  | rank | score | doc | chunk | section_heading | text |" and table[1] == "|" + "---|" * 7 and len(table) == 5
    assert Presenter(style="compact", max_text_chars=0).format_result(r[0], set()) == ["  CAVAB #1  score=0.5000  doc=a  chunk=a::0000  [H]"]
    with pytest.raises(ValueError):
        Presenter(style="x")


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "d.txt").write_text("Maddə 1. Ad\nBu maddədə ad haqqında qayda yazılıb.", "utf-8")
    s = ["--store", str(tmp_path / "st")]
    assert cli.main(["search", "x", *s], spark) == 1
    assert cli.main(["index", str(tmp_path / "d.txt"), "--domain", "legal", *s], spark) == 0
    assert cli.main(["search", "ad", "--json", *s], spark) == 0
    assert cli.main(["chunk", str(tmp_path / "d.txt"), "--domain", "legal"], spark) == 0
    (tmp_path / "q.json").write_text(json.dumps([{"query": "ad", "relevant_ids": ["d"]}]))
    assert cli.main(["eval", str(tmp_path / "q.json"), "--out", str(tmp_path / "r.json"), *s], spark) == 0
    assert cli.main(["eval", str(tmp_path / "q.json"), "--store", str(tmp_path / "none")], spark) == 1
    assert cli.main(["index", str(tmp_path / "d.txt"), "--backend", "memory", "--save", str(tmp_path / "i.json")], spark) == 0
    other = ["--store", str(tmp_path / "untouched"), "--load", str(tmp_path / "i.json")]
    assert cli.main(["search", "ad", *other], spark) == 0 and not (tmp_path / "untouched").exists()
    out = capsys.readouterr().out
    assert "[general] d" in out
    assert "d::0000" in out and json.loads((tmp_path / "r.json").read_text())["aggregate"]["recall"] == 1.0


def test_md5_grams_of_long_texts(spark):
    """A text is walked once, however long it is: cutting every gram from its beginning took minutes for this one."""
    import hashlib
    import math
    import time
    from collections import Counter

    def plain(texts):
        t = [f" {X.az_lower(x)} " for x in texts if x is not None]
        grams = Counter(x[i : i + 3] for x in t for i in range(len(x) - 2))
        sums = {}
        for g, n in grams.items():
            h = int(hashlib.md5(g.encode()).hexdigest()[:7], 16)
            sums[(h >> 1) % 256] = sums.get((h >> 1) % 256, 0) + (n if h % 2 == 0 else -n)
        return {b: math.copysign(math.log1p(abs(s)), s) for b, s in sums.items()}

    long = "".join(chr(97 + i * i % 23) + "əİI 😀"[i % 5] * (i % 3) for i in range(500_000))
    rows = [(1, long), (2, ""), (3, None), (4, "ab"), (4, "b"), (None, "salam"), (5, "".join(map(chr, range(0x4E00, 0x4E00 + 9000))))]
    began = time.time()
    got = {}
    for r in embed.hashed_md5(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").collect():
        got.setdefault(r["id"], {})[r["bucket"]] = r["value"]
    assert time.time() - began < 60
    assert set(got) == {1, 4, 5, None}
    for key in got:
        want = plain([t for i, t in rows if i == key])
        assert got[key].keys() == want.keys() and all(abs(got[key][b] - want[b]) < 1e-9 for b in want)


def test_hashed_embedder_holds_no_batch():
    """Six million characters at once: arrays over all of them took more than 500 MB."""
    import tracemalloc

    texts = ["salam dünya, necəsən " * 50] * 6000 + ["uzun mətn " * 100_000]
    tracemalloc.start()
    v = embed.Hashed(64).vectors(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300e6 and len(v) == 6001 and all(abs(a - b) < 1e-12 for a, b in zip(v[0], embed.Hashed(64).vectors(texts[:1])[0]))


def test_all_vectors_of_a_label_are_relevant(spark, tmp_path):
    """A query's gold ids are all vectors of its label, far ones too: the nearest vector of query 0 is the last row."""
    rows = [(i, [1.0, 0.0] if i in (0, 299) else [0.0, 1.0], (0 if i in (0, 299) else 1)) for i in range(300)] + [(350, [-1.0, 0.0], None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["query_id"]: r for r in queries.retrieval_metrics(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 50, 100, 150, 200, 250}
    assert (got[0]["rr"], got[0]["recall"], got[0]["ndcg"]) == (1.0, 1.0, 1.0)
    assert (got[50]["rr"], got[50]["recall"], got[50]["ndcg"]) == (1.0, round(5 / 298, 6), 1.0)
    assert {(r["domain"], r["mrr"], r["n"]) for r in queries.eval_grouping(spark, str(tmp_path)).collect()} == {("all", 1.0, 6), ("0", 1.0, 1), ("1", 1.0, 5)}


def test_compose_holds_few_texts():
    """A batch of 40 MB is composed a few texts at a time: the Python strings of all of them took more than its own size."""
    import tracemalloc

    import pyarrow as pa

    batch = pa.array(["é" * 10_000, None, ""] * 700)
    tracemalloc.start()
    n = 0
    for piece in X.composed(iter([batch, batch.slice(0, 0)]), "NFC"):
        assert len(piece) <= X.RUN_ROWS and set(piece.to_pylist()) <= {"é" * 10_000, None, ""}
        n += len(piece)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(batch) and most < 10e6
