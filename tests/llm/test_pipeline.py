"""The stages in order, each on what the one before kept, over rows with planted cases."""

import random

import corpus_pipeline
from bulaq.llm import decontaminate, kneser, sanitize, simhash, spiece
from tests.llm.test_operators import SCHEMA, WORDS, prose, row


def test_pipeline(spark, tmp_path):
    r = random.Random(21)
    item = prose(r, 30)
    rows = [row(i, prose(r, r.randint(40, 120))) for i in range(200)]
    rows = [x if x[0] % 4 else row(x[0], f"{x[1]} {r.choice(WORDS)}{x[0]}@mail.example {prose(r, 9)}") for x in rows]
    labels = [(i, 1, 0) for i in range(150)]
    junk = [row(1000 + i, " ".join(w + "%%%" for w in prose(r, 50).split())) for i in range(10)]
    words = prose(r, 150).split()
    copies = [row(2000 + i, " ".join(words if i == 0 else [*words[:20], "other", *words[21:]])) for i in range(5)]
    leaks = [row(3000 + i, f"{prose(r, 30)} {item} {prose(r, 30)}") for i in range(3)]
    private = [row(4000 + i, f"{prose(r, 30)} jo{i}@mail.example {prose(r, 30)}") for i in range(3)]
    spark.createDataFrame(rows + junk + copies + leaks + private, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-dedup", "decontamination", "pii", "sentencepiece"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {x["doc_id"]: x for x in docs.collect()}
    assert {i for i in got if i < 1000} == set(range(200)) and not {i for i in got if 1000 <= i < 2000}
    assert [i for i in got if 2000 <= i < 3000] == [2000] and not {i for i in got if 3000 <= i < 4000}
    assert all("@" not in got[4000 + i]["text"] and "[EMAIL]" in got[4000 + i]["text"] and got[4000 + i]["n_chars"] == len(got[4000 + i]["text"]) for i in range(3))
    assert all(x["n_tokens"] == len(x["ids"]) > 0 for x in got.values())
    assert {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(got)


def written(spark, tmp_path, docs, labels, bench):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_awkward_tables(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, clashing extra columns; no labels, no items; no documents."""
    r = random.Random(22)
    same, long = prose(r, 50), " ".join(prose(r, 60) for _ in range(300))
    rows = [row(1, same), row(1, same), row(2, None), row(3, ""), row(None, prose(r, 50)), row(4, long, None), (5, prose(r, 50), None, None, None), row(6, same)]
    extra = "gone bigint, ids string, clean boolean, kept boolean, lm_score double, block int, marks string, n_entities string"
    docs = spark.createDataFrame([(*x, 1, "i", True, False, 0.5, 3, "m", "e") for x in rows], f"{SCHEMA}, {extra}")
    for i, (labels, bench) in enumerate([([], []), ([(1, 1, 0), (None, 1, 0), (5, None, None)], [(1, None), (None, ""), (2, prose(r, 20))])]):
        at = written(spark, tmp_path / str(i), docs, labels, bench)
        out = corpus_pipeline.run(spark, at)
        got = out.collect()
        assert out.columns[: len(docs.columns)] == docs.columns and all(x["clean"] and x["block"] == 3 and x["ids"] == "i" for x in got)
        want = {1, None, 4, 5} if not labels else {x["doc_id"] for x in got}
        assert {x["doc_id"] for x in got} == want and sum(x["doc_id"] == 1 for x in got) in (0, 2) and not {2, 3, 6} & {x["doc_id"] for x in got}
    at = written(spark, tmp_path / "none", docs.limit(0), [], [])
    assert corpus_pipeline.run(spark, at).count() == 0


def test_each_stage_against_brute_force(spark, tmp_path):
    """Every stage's rows by plain code on its own input, in the order of the pipeline."""
    import numpy as np
    import pyarrow as pa

    from bulaq.llm import arrowtext as A
    from tests.llm.test_operators import brute_kneser

    r = random.Random(23)
    items = [prose(r, 25), prose(r, 5)]
    rows = [row(i, prose(r, r.randint(30, 90))) for i in range(60)]
    rows += [row(100 + i, " ".join(r.choice(["%%%", "#1#", "@@"]) + w for w in prose(r, 40).split())) for i in range(6)]
    base = prose(r, 120).split()
    rows += [row(200 + i, " ".join([*base[:i], "zz", *base[i + 1 :]])) for i in range(4)] + [row(210, " ".join(base))] * 2
    rows += [row(300, f"{prose(r, 20)} {' '.join(items[0].split()[4:14])} {prose(r, 20)}"), row(301, f"{prose(r, 20)} {items[1]} {prose(r, 9)}")]
    rows += [row(400 + i, f"{prose(r, 30)} jo{i}@mail.example {prose(r, 30)} tel +1 (564) 555-45{i:02d}") for i in range(5)]
    trusted = lambda i: i < 60 or i >= 200
    labels = [(x[0], 1, 0) for x in rows if trusted(x[0])]
    docs = spark.createDataFrame(rows, SCHEMA)
    at = written(spark, tmp_path, docs, labels, list(enumerate(items)))
    steps = dict(corpus_pipeline.STAGES)

    # 1. plain dictionaries give the scores; the limit is recomputed from the held-out trusted texts
    out, score, _ = kneser.classify(docs, kneser.trusted_rows(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    scored = {x["doc_id"]: x[score] for x in out.collect()}
    import pyspark.sql.functions as F

    fold = {x["doc_id"]: x["f"] for x in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(kneser.HELD_OUT)).alias("f")).collect()}
    f = brute_kneser([t for i, t, *_ in rows if trusted(i) and fold[i]])
    held = [(f(t), len(t)) for i, t, *_ in rows if trusted(i) and not fold[i]]
    mean = sum(a for a, _ in held) / sum(n for _, n in held)
    value = lambda nll, n: (nll + kneser.PRIOR * mean) / (n + kneser.PRIOR)
    own = sorted(value(*x) for x in held)
    q = lambda p: own[max(0, int(np.ceil(p * len(own))) - 1)]
    limit = q(0.5) + kneser.SLACK * (q(kneser.QUANTILE) - q(0.5))
    good = [x for x in rows if value(f(x[1]), len(x[1])) <= limit]
    assert all(abs(scored[i] - value(f(t), len(t))) < 1e-6 for i, t, *_ in rows)
    now = steps["quality classifier"](spark, docs, at)
    assert sorted(map(tuple, now.collect())) == sorted(good) and len(good) >= 70 and not [x for x in good if 100 <= x[0] < 200]

    # 2. all pairs
    sig, _ = simhash.signatures(*A.code_points(pa.array([x[1] for x in good])))
    words = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t).split()
    runs = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for w in (words(x[1]) for x in good)]
    root = {x[0]: x[0] for x in good}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(good)):
        for j in range(i):
            near = int(np.bitwise_count(sig[i] ^ sig[j]).sum()) <= simhash.MAX_DISTANCE and len(runs[i] & runs[j]) >= simhash.MIN_JACCARD * len(runs[i] | runs[j])
            if near or good[i][1] == good[j][1]:
                a, b = sorted((find(good[i][0]), find(good[j][0])))
                root[b] = a
    single = [x for x in good if find(x[0]) == x[0]]
    now = steps["near-dedup"](spark, now, at)
    assert sorted(map(tuple, now.collect())) == sorted(single) and len([x for x in single if 200 <= x[0] < 300]) == 1

    # 3. eight words in a row, or all of a shorter item
    has = lambda t, w: any(t[i : i + len(w)] == w for i in range(len(t) - len(w) + 1))
    parts = [w[k : k + 8] for w in map(words, items) for k in range(max(1, len(w) - 7))]
    clean = [x for x in single if not any(has(words(x[1]), p) for p in parts)]
    now = steps["decontamination"](spark, now, at)
    assert sorted(map(tuple, now.collect())) == sorted(clean) and not [x for x in clean if 300 <= x[0] < 400]

    # 4. every entity replaced by its kind, and terms by the counts of test_sanitisation
    gone = {x["term"] & (2**64 - 1): x["gone"] for x in sanitize.disclosing(now).collect()}
    plain = []
    for i, t, *rest in clean:
        spans = sanitize.entities(t)
        cut = [(a, b, f"[{k}]") for a, b, k in spans]
        at_ = 0
        for w in words(t):
            a = t.lower().index(w, at_)
            at_ = a + len(w)
            h = A.hash_word(w)
            if h in gone and not any(x < at_ and a < y for x, y, _ in spans):
                cut.append((a, at_, "" if gone[h] else sanitize._general(t[a:at_])))
        for a, b, new in sorted(cut, reverse=True):
            t = t[:a] + new + t[b:]
        plain.append((i, t, *rest[:-1], len(t)))
    now = steps["pii"](spark, now, at)
    assert sorted(map(tuple, now.collect())) == sorted(plain) and sum("[EMAIL]" in x[1] and "[PHONE]" in x[1] for x in plain) == 5

    # 5. the model's own library
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spiece.MODEL)
    got = steps["sentencepiece"](spark, now, at).collect()
    assert sorted((x["doc_id"], x["text"], list(x["ids"]), x["n_tokens"]) for x in got) == sorted((i, t, sp.encode(t), len(sp.encode(t))) for i, t, *_ in plain)
    assert sorted(map(str, corpus_pipeline.run(spark, at).collect())) == sorted(map(str, got)) and decontaminate.WINDOW == 8
