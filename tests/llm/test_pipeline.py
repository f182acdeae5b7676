"""The corpus pipeline stage by stage against plain code."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import exact_dedup, mixing, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_columns_and_rows(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == COLUMNS
        assert after.exceptAll(before.withColumn("n", F.lit(1)).drop("n")).join(before, "doc_id", "left_anti").count() == 0


def test_language_keeps_texts_with_letters(stages):
    before, after = stages[0], stages[1]
    gone = before.join(after, "doc_id", "left_anti").collect()
    assert len(gone) <= 0.02 * before.count()


def test_copies_go(stages):
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    best = {}
    for r in stages[1].collect():
        best[lower(r.text)] = min(r.doc_id, best.get(lower(r.text), r.doc_id))
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(best.values())


def test_copies_go_by_row(spark):
    rows = [
        (1, "One text."), (1, "One text."), (1, "one TEXT."), (2, "one text."), (None, "One text."),  # one row of 1
        (3, "Own text of three."), (3, "ONE TEXT."), (4, "Own text of three."),  # 3 keeps the text of its own
        (None, "Nobody's."), (None, "nobody's."), (None, "Other."),  # one of each
        (5, None), (None, ""), (6, ""),  # null is empty
        (7, "Alone."),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.first_copies(spark, docs.repartition(4), SF)
    assert got.columns == COLUMNS
    assert sorted(((r.doc_id or 0), (r.text or "").lower()) for r in got.collect()) == [
        (0, "nobody's."), (0, "other."), (1, "one text."), (3, "own text of three."), (5, ""), (7, "alone."),
    ]


def test_copies_go_with_any_columns(spark):
    """A map column, which has no order, and columns named like those of the operators."""
    row = "row bigint, head string, norm string, m map<string,int>, keep_id bigint, part int, label bigint, n int"
    rows = [(i, t, "en", "s", 1, 5, "h", "n", {"a": i}, 3, 2, 1, 9) for i, t in ((1, "A b c."), (2, "a B c."), (3, "d"), (3, "D"), (None, "d"))]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars int, {row}").repartition(3)
    for stage in (corpus_pipeline.first_copies, corpus_pipeline.one_of_near_copies):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert sorted((r.doc_id, r.text.lower(), r.m["a"]) for r in got.collect()) == [(1, "a b c.", 1), (3, "d", 3)]
    assert corpus_pipeline.mixed_to_weights(spark, docs, SF).columns == docs.columns


def test_near_copies_go_by_row(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "other"])
    rows = [
        (5, " ".join(base)), (4, near), (4, "a text of its own that stays here"),  # 4 keeps both: it is the smallest
        (9, near + " x"), (9, "another text of its own that stays"), (None, near), (None, "nobody has this one text"),
        (7, None), (7, ""), (8, " "),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.one_of_near_copies(spark, docs.repartition(4), SF)
    assert sorted(((r.doc_id or 0), r.text or "") for r in got.collect()) == sorted([
        (4, near), (4, rows[2][1]), (9, rows[4][1]), (0, rows[6][1]), (7, ""), (7, ""), (8, " "),
    ])


def test_many_copies_over_many_partitions(spark):
    """One row again and again, on most rows, dealt over many partitions: one stays."""
    rows = [(3, "Same text.")] * 900 + [(2, "same text.")] * 5 + [(i, f"text {i % 40}") for i in range(100, 300)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    found = exact_dedup.exact_duplicates(docs.repartition(7), keep="largest").collect()
    kept = sorted((r.doc_id, r.group_size) for r in found if r.kept)
    assert kept == [(3, 905), *((i, 5) for i in range(260, 300))] and len(found) == len(rows)
    assert sum(r.kept for r in found) == 41
    got = corpus_pipeline.first_copies(spark, docs.repartition(7), SF)
    assert sorted(r.doc_id for r in got.collect()) == [2, *range(100, 140)]


def test_near_copies_go(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]

    def shingles(text):
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b:
                shared = len(sets[a] & sets[b])
                if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted({find(i) for i in sets})


def plain_mixture(docs, labels):
    """Rows a document is taken: naive Bayes and projected gradient in numpy, over plain lists."""
    domains = list(queries.TARGETS)
    own = {}
    for doc_id, quality, toxic in labels:
        q, t = own.get(doc_id, (None, None))
        own[doc_id] = (quality if q is None else q if quality is None else min(q, quality), toxic if t is None else t if toxic is None else max(t, toxic))
    domain = {i: "toxic" if t == 1 else "poor" if q == 0 else "clean" if q == 1 else None for i, (q, t) in own.items()}

    def seen(text):
        words = [w for w in text.lower().translate({ord(c): " " for c in mixing.PUNCTUATION}).split(" ") if w]
        size = max(len(text), 1)
        shares = [
            sum(c in mixing.SYMBOLS for c in text) / size,
            sum("A" <= c <= "Z" for c in text) / size,
            1 - len(set(words)) / max(len(words), 1),
        ]
        return set(words), len(words), [sum(x > b for b in mixing.BINS) for x in shares]

    rows = [(i, *seen(text or "")) for i, text in docs]
    known = [(w, b, domains.index(domain[i])) for i, w, _, b in rows if domain.get(i) in domains]
    n = [sum(k == d for *_, k in known) for d in range(len(domains))]
    total = max(len(known), 1)
    df = {}
    for words, _, k in known:
        for w in words:
            df.setdefault(w, [0] * len(domains))[k] += 1
    share = lambda c, of: (c + 0.5) / (of + 1.0)
    scored = []
    for w, by in df.items():
        c = sum(by)
        chi = sum((x - c * m / total) ** 2 / (c * m / total) for x, m in zip(by, n, strict=True) if m)
        ratio = max(share(x, m) / share(c - x, total - m) for x, m in zip(by, n, strict=True))
        if c >= mixing.LEAST_COUNT and ratio >= mixing.LEAST_RATIO and chi >= mixing.LEAST_CHI:
            scored.append((-chi, w, by))
    best = sorted(scored)[: mixing.VOCABULARY]
    posteriors = []
    for _, words, _, bins in rows:
        score = []
        for k in range(len(domains)):
            s = np.log((n[k] + 1) / (total + len(domains)))
            for _, w, by in best:
                p = share(by[k], n[k])
                s += np.log(p if w in words else 1 - p)
            for j, b in enumerate(bins):
                s += np.log((sum(x[1][j] == b and x[2] == k for x in known) + 0.5) / (n[k] + 0.5 * (len(mixing.BINS) + 1)))
            score.append(s)
        e = np.exp(np.array(score) - max(score))
        posteriors.append(e / e.sum())
    p, size = np.array(posteriors), np.array([r[2] for r in rows], dtype=float)
    mass = (p * size[:, None]).sum(axis=0)
    weights = np.array([queries.TARGETS[d] for d in domains])
    wanted = mass[domains.index("clean")] / weights[domains.index("clean")] * weights
    inverse = np.linalg.pinv((p * size[:, None]).T @ p, rcond=1e-9)
    steps = np.zeros(len(domains))
    for _ in range(100_000):
        rates = np.maximum(0.0, 1.0 + p @ steps)
        away = wanted - (p * (size * rates)[:, None]).sum(axis=0)
        if np.abs(away).max() <= 1e-7 * wanted.sum():
            break
        steps = steps + inverse @ away
    return {r[0]: x for r, x in zip(rows, np.maximum(0.0, 1.0 + p @ steps).tolist(), strict=True)}, away / wanted.sum()


def test_mixing_takes_what_plain_code_takes(spark, tmp_path):
    rng = random.Random(6)
    pools = {"clean": [f"calm{i}" for i in range(60)], "poor": [f"junk{i}" for i in range(40)], "toxic": [f"vile{i}" for i in range(30)]}
    rows, labels = [], []
    for i in range(400):
        kind = rng.choices(list(pools), [6, 3, 1])[0]
        other = rng.choice(list(pools))
        own = rng.randrange(5, 60)
        words = rng.choices(pools[kind], k=own) + rng.choices(pools[other], k=rng.choice([0, 0, 0, 2, 9]))
        rng.shuffle(words)
        text = " ".join(words)
        rows.append((3 * i, text.upper() if i % 9 == 0 else text + " #$%" * (i % 4)))
        if i % 2:
            labels.append((3 * i, int(kind == "clean"), int(kind == "toxic")))
    rows += [(5000, None), (5003, "")]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    rates, away = plain_mixture(rows, labels)
    assert np.abs(away).max() <= 1e-6 and len(set(rates.values())) > 50
    uniform = {
        r.doc_id: r.u
        for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1_000_003)) / 1_000_003.0).alias("u")).collect()
    }
    want = {i: int(np.floor(rate + uniform[i])) for i, rate in rates.items()}
    close = {i for i, rate in rates.items() if abs((rate + uniform[i]) % 1.0 - 0.5) > 0.49}
    got = {r.doc_id: r["count"] for r in corpus_pipeline.mixed_to_weights(spark, docs, str(tmp_path)).groupBy("doc_id").count().collect()}
    assert {i: n for i, n in got.items() if i not in close} == {i: n for i, n in want.items() if n and i not in close}
    assert len(close) < 30 and {0, 1} <= set(want.values())


def test_mixing_out_of_reach_comes_no_nearer_than_it_says(spark):
    """Every row is half of each domain: no rates give 90 to 10, and the residual says so."""
    members = spark.createDataFrame([(10, 0.5, 0.5)] * 20, "mix_n bigint, p_a double, p_b double")
    steps, residual = mixing.fit_rates(members, {"a": 0.9, "b": 0.1})
    assert residual["a"] == pytest.approx(0.4, abs=1e-3) and residual["b"] == pytest.approx(-0.4, abs=1e-3) and len(steps) == 2


def test_run_deletes_what_stages_store(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.iterdir())
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before}
    assert left == {f"stage-{name}" for name, _ in corpus_pipeline.STAGES}


def test_tokens_are_of_the_mixture(stages):
    mixed = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert mixed == {r.doc_id: r["count"] for r in stages[5].groupBy("doc_id").count().collect()}
    whole = stages[5].join(stages[4].dropDuplicates(["doc_id"]), "doc_id")
    assert whole.filter(F.sha2("text", 256) != F.col("decoded_sha256")).count() == 0


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.exceptAll(stages[-1]).count() == 0 and got.count() == stages[-1].count()


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
