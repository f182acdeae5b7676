"""Operators for training text against plain code, on small tables with every kind of odd row."""

import base64
import hashlib
import html
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from plumbline.llm import (
    bpe,
    components,
    crf,
    exact_dedup,
    html_text,
    language,
    merkle,
    mixing,
    ngram_join,
    personal_data,
    queries,
    substring,
    token_files,
)

SCHEMA = "doc_id bigint, text string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, a shared passage, short, empty, null, long and repeated rows."""
    rng = random.Random(5)
    base = words(rng, 120)
    passage = words(rng, 50)
    texts = [" ".join(base), " ".join(base).upper(), "\t".join(base) + "\n"]
    for i in range(12):
        near = list(base)
        for _ in range(i // 2):
            near[rng.randrange(len(near))] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(near))
    for i in range(10):
        own = words(rng, 30 + 40 * i, 5000)
        at = rng.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    texts += ["", None, "one", "one", "two three four", "Two three FOUR", "a b c d e", "a b c d e f", " ", "é È ß   x"]
    texts += [" ".join(words(rng, 4000, 9000)), "same " * 200, "same " * 200]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows.append(rows[0])  # a whole row again
    rows.append((rows[4][0], "an identifier with another text of its own"))
    rows += [(None, texts[0]), (None, "no identifier here at all")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame(corpus, SCHEMA).select(
        "*", F.lit(1).alias("n_tokens"), F.lit("x").alias("token"), F.lit(2).alias("label"), F.lit(0).alias("kept")
    )


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# Byte pairs


def codec(leaf):
    return bpe.Codec(queries.RANKS, public_tokenizers.PATTERN, leaf)


def plain_encoding():
    with open(queries.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ranks, tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_encoding_equals_encoding_at_once():
    _, plain = plain_encoding()
    rng = random.Random(1)
    small = codec(8)
    pieces = ["a", "the", " ", "  ", "\n", "'s", "'ll", "'", "12", "5", "é", "中", "!", "***", " ", "\u0085", "\x1c", "٣", "Z" * 9]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["abcdefghij" * 300, " " * 500, "x" * 2000 + " " + "y" * 2000, "\n" * 40 + "a", "'" * 30 + "s", "1" * 300 + "'ll" * 20]
    for text in texts:
        ids = small.encode(text)
        assert ids.tolist() == plain.encode_ordinary(text), text[:80]
        assert small.decode(ids) == text.encode()


def test_every_token_encodes_to_itself():
    """What joins inside a piece rest on."""
    ranks, plain = plain_encoding()
    for token, rank in random.Random(2).sample(sorted(ranks.items()), 4000):
        parts = [bytes([b]) for b in token]
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            assert parts[at] + parts[at + 1] in ranks, token
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert ranks[parts[0]] == rank


def test_encode_decode(docs, corpus, nothing):
    _, plain = plain_encoding()
    got = sorted(bpe.encode_decode(docs, queries.RANKS, public_tokenizers.PATTERN).collect(), key=repr)
    want = [
        (i, np.array(plain.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for i, t in corpus
    ]
    assert [(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got] == [
        (r[0], bytes(r[1]), bytes(r[2])) for r in sorted(want, key=lambda w: repr((w[0], bytearray(w[1]), bytearray(w[2]))))
    ] or sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == sorted((str(a), b, c) for a, b, c in want)
    assert bpe.encode_decode(nothing, queries.RANKS, public_tokenizers.PATTERN).count() == 0


# Similarity join


def shingles(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4)))


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        shared = len(x & y)
        if shared and 100 * shared >= 75 * (len(x) + len(y) - shared):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {(i, len(s), find(i)) for i, s in sets}


def test_similar_documents(docs, corpus, nothing, spark):
    clean = [r for r in dict.fromkeys(corpus) if r[0] is not None and "another text" not in (r[1] or "")]
    got = ngram_join.similar_documents(spark.createDataFrame(clean, SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute_components(clean) and len(got) == len(clean)
    odd = ngram_join.similar_documents(docs).collect()
    assert len(odd) == len(corpus) and [r.component_id for r in odd if r.doc_id is None] == [None, None]
    assert {r.component_id for r in odd if r.doc_id == corpus[0][0]} == {1}
    assert ngram_join.similar_documents(nothing).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_documents_near_the_threshold(spark, seed):
    """A group of near copies around the threshold: stars, chains and documents left outside."""
    rng = random.Random(seed)
    base = words(rng, 60)
    rows = []
    for i in range(60):
        own = list(base) if i % 3 else words(rng, 20) + base[:40]
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"y{rng.randrange(40)}"
        rows.append((i, " ".join(own[: rng.randrange(45, 61)])))
    got = ngram_join.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute_components(rows)


def brute_links(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = dict.fromkeys((i for i, _ in sets), 0)
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        shared = len(x & y)
        if shared and 100 * shared >= 75 * (len(x) + len(y) - shared):
            links[a] += 1
            links[b] += 1
    return links


@pytest.mark.parametrize("seed", [1, 2])
def test_every_link_is_counted(spark, seed):
    rng = random.Random(seed)
    base = words(rng, 60)
    rows = []
    for i in range(60):
        own = list(base) if i % 3 else words(rng, 20) + base[:40]
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"y{rng.randrange(40)}"
        rows.append((i, " ".join(own[: rng.randrange(45, 61)])))
    rows += [(100 + i, rows[i % 5][1].upper()) for i in range(12)] + [(200, ""), (201, None), (202, "a b"), (203, "A  b")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.n_links for r in ngram_join.link_counts(frame).collect()} == brute_links(rows)


def test_buckets_dealt_in_parts_give_the_same_pairs(spark):
    rows = [(i, 10, 0, [7, 8] if i % 2 else [7], b"") for i in range(40)] + [(99, 10, 0, [9], b"")]
    prefixes = spark.createDataFrame(rows, ngram_join.PREFIXES_SQL)
    want = {(a, b) for a, b in itertools.combinations(range(40), 2)}
    for together in (3, 512):
        got = [tuple(r) for r in ngram_join.pairs_in_buckets(prefixes, 75, together).collect()]
        assert set(got) == want and len(got) == len(want)


def test_link_counts_of_odd_rows(docs, corpus, nothing, spark):
    clean = [r for r in dict.fromkeys(corpus) if r[0] is not None and "another text" not in (r[1] or "")]
    got = ngram_join.link_counts(spark.createDataFrame(clean, SCHEMA)).collect()
    assert {r.doc_id: r.n_links for r in got} == brute_links(clean)
    assert ngram_join.link_counts(nothing).count() == 0
    assert {r.doc_id for r in ngram_join.link_counts(docs).collect()} == {i for i, _ in corpus if i is not None}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (200, 200)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.id: r.label for r in components.components(frame).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# Mixing


def test_rates_meet_targets(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        p = rng.choice([(0.9, 0.1), (0.2, 0.8), (0.5, 0.5), (1.0, 0.0)])
        rows.append((i, rng.randrange(1, 500), *p))
    members = spark.createDataFrame(rows, "doc_id bigint, mix_n bigint, p_a double, p_b double").cache()
    for targets in ({"a": 0.6, "b": 0.4}, {"a": 0.8, "b": 0.2}, {"a": 0.35, "b": 0.65}):
        steps, residual = mixing.fit_rates(members, targets)
        assert max(map(abs, residual.values())) <= 1e-4
        rate = mixing.rate(("a", "b"), steps)
        got = members.agg(F.sum(rate * F.col("mix_n") * F.col("p_a")), F.sum(rate * F.col("mix_n") * F.col("p_b")), F.min(rate)).first()
        total = sum(r[1] for r in rows)
        assert got[0] == pytest.approx(targets["a"] * total, abs=2e-4 * total)
        assert got[1] == pytest.approx(targets["b"] * total, abs=2e-4 * total) and got[2] >= 0
    assert mixing.fit_rates(members.limit(0), {"a": 1.0, "b": 1.0}) == ((0.0, 0.0), {"a": 0.0, "b": 0.0})


def test_mixing_learns_domains(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(300):
        kind = i % 3
        own = words(rng, 40)
        if kind == 1:
            own = [w + "***" for w in own]
        if kind == 2:
            own[5] = "vile"
        rows.append((i, " ".join(own)))
        if i < 200:
            marks.append((i, 0 if kind == 1 else 1, int(kind == 2)))
    rows += [(1000, None), (1001, ""), (None, "w1 w2")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("rate", F.lit(9)).withColumn("p_clean", F.lit(9))
    labels = spark.createDataFrame([*marks, (None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    mixture, members = mixing.fit(frame.select("doc_id", "text", "rate"), labels, queries.TARGETS, anchor="clean")
    found = {r.doc_id: r for r in members.collect()}
    right = [max(queries.TARGETS, key=lambda d: found[i][f"p_{d}"]) == ("clean", "poor", "toxic")[i % 3] for i in range(200, 300)]
    assert sum(right) >= 97 and found[1000].mix_n == 0
    assert mixture.classifier.words and "vile" in mixture.classifier.words
    untold, _ = mixing.fit(frame.select("doc_id", "text"), labels.limit(0), queries.TARGETS)
    assert untold.classifier.words == ()
    assert mixing.fit(frame.limit(0).select("doc_id", "text"), labels, queries.TARGETS)[0].steps == (0.0, 0.0, 0.0)


# Exact duplicates


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("partitions", [1, 7])
def test_exact_duplicates(spark, docs, corpus, nothing, keep, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = exact_dedup.exact_duplicates(docs, keep=keep).collect()
        assert exact_dedup.exact_duplicates(nothing).count() == 0
        many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text"))
        row = exact_dedup.exact_duplicates(many, keep=keep).agg(
            F.min("group_size"), F.max("group_size"), F.sum(F.col("kept").cast("int")), F.max("keep_id"), F.count("*")
        ).first()
        assert tuple(row) == (3000, 3000, 1, 0 if keep == "smallest" else 2999, 3000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    groups = {}
    for doc_id, text in corpus:
        groups.setdefault(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""), []).append(doc_id)
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(known) if known else None
        want += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
        digest = want[-1][-1]
        assert sum(r.kept for r in got if r.text_sha256 == digest) == 1
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(want, key=repr)


# Fingerprints


def test_fingerprints_of_neighbours(docs, corpus, nothing):
    got = merkle.compare_with_next(docs).collect()
    assert len(got) == len(corpus)
    least = {}
    for i, t in corpus:
        if i is not None:
            least[i] = min(least.get(i, t or ""), t or "", key=lambda s: s.encode())
    ids = sorted(least, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    prints = {}
    for r in got:
        texts = {t or "" for i, t in corpus if i == r.doc_id}
        edits = set()
        for t in texts:
            k = len(t) // 3
            edits.add(t[: len(t) - k] + (least[after[r.doc_id]][:k] if r.doc_id is not None else ""))
        assert r.edited in edits and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(texts) == 1:
            prints.setdefault(texts.pop(), set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) == len(prints)
    assert merkle.compare_with_next(nothing).count() == 0


def test_changed_paragraphs_are_located(spark):
    lines = [f"line {i} with some text of its own" for i in range(30)]
    other = list(lines)
    other[17] = "changed"
    frame = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "one string, two string")
    made = merkle.with_fingerprint(merkle.with_fingerprint(frame, "one", "a", parts=True), "two", "b", parts=True)
    row = made.select(
        merkle.changed_paragraphs(F.col("a_paragraphs"), F.col("b_paragraphs")).alias("p"),
        merkle.changed_paragraphs(F.col("a_sections"), F.col("b_sections")).alias("s"),
        merkle.likeness(F.col("a"), F.col("b")).alias("near"),
    ).first()
    assert row.p == [17] and row.s == [17 // merkle.SECTION] and 0.9 < row.near < 1


# Language


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = queries.op6(spark, sf).join(docs, "doc_id")
    rows = found.collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97 and all(0 <= r.score <= 1 for r in rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in language.accepted(docs, queries.language_dictionaries(docs)).select("doc_id").collect()}
    assert kept == {r.doc_id for r in rows if r.told}


def test_language_of_odd_rows(spark, docs, nothing):
    tools = {"aa": b"alo mira tenu soba kelo wani " * 20, "bb": b"dum krat spol vrin glast pruk " * 20}
    frame = spark.createDataFrame(
        [(1, "Alo mira tenu!"), (2, "spol VRIN 12 glast"), (3, None), (4, "12 *** 3"), (5, ""), (None, "kelo wani alo " * 9000)], SCHEMA
    )
    got = {r.doc_id: r.lang_pred for r in language.predict_language(frame, tools).collect()}
    assert got == {1: "aa", 2: "bb", 3: "und", 4: "und", 5: "und", None: "aa"}
    assert language.predict_language(frame, {}).select("lang_pred").distinct().collect()[0][0] == "und"
    kept = language.accepted(frame.withColumn("score", F.lit(1)), tools).collect()
    assert {r.doc_id for r in kept} == {1, 2, None} and kept[0].score == 1
    assert language.predict_language(nothing, tools).count() == 0
    assert language.fit_dictionaries(nothing.withColumn("lang", F.lit("x"))) == {}
    assert language.Compressors(tools).told("q" * 4000, 0.5) is False


def test_labelled_rows_are_those_of_least_hash(spark, monkeypatch):
    rows = [(i, f"text {i}", "hot" if i % 5 else "rare") for i in range(3000)] + [(7, "again", "rare")] * 3
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    hashes = {r.id: r.h for r in frame.selectExpr("doc_id as id", "xxhash64(cast(doc_id as string)) as h").collect()}
    sample = frame.selectExpr("lang", "xxhash64(cast(doc_id as string)) as hash")
    monkeypatch.setattr(language, "BITS", 4)
    monkeypatch.setattr(language, "NEAR", 2)
    for wanted in (1, 40, 5000):
        cuts, counts = language.cut_offs(sample, wanted)
        for lang in ("hot", "rare"):
            own = sorted((hashes[i], str(i), text) for i, text, x in rows if x == lang)
            below = sum(h <= cuts[lang] for h, _, _ in own)
            assert counts[lang] == len(own) and min(wanted, len(own)) <= below <= wanted + 4
            plain = " ".join(language.letters(text) for _, _, text in own[:wanted]).encode()
            assert language.fit_dictionaries(frame, rows=wanted)[lang] == plain[-language.DICTIONARY_BYTES :]


def test_language_is_rejected_by_narrow_margin(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tools = language.Compressors(queries.language_dictionaries(docs))
    told = lambda text: tools.told(text, language.MARGIN)
    assert not told("xqzt vbnk wrtp lkjh zzxq qqwv") and not tools.told("xqzt vbnk wrtp lkjh zzxq qqwv", 0.0)
    held = docs.filter(queries.held_out(docs.doc_id)).collect()
    assert sum(told(r.text) for r in held) >= 0.98 * len(held)
    rng = random.Random(3)
    for n in (5, 20, 100, 500):
        noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(n)) for _ in range(100)]
        assert sum(map(told, noise)) <= 5


# Pages


def test_main_text_of_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op7(spark, sf).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S).group(1)
        body = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:h1|p|br)>", " ", body))
        assert r.text == " ".join(html.unescape(body).split()) and r.n_chars == len(r.text)


def test_unseen_page_layout(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><p>Site name and a slogan.</p></header>"
        "<nav><a href=/a>Home</a> <a href=/b>News</a></nav><div class='cookie-banner'><p>We use cookies, please accept them all.</p></div>"
        "<main><h1>Title &amp; more</h1><p>First <b>bold</b>   paragraph,\nwith text that is long enough to read.</p>"
        "<script>var x='<p>no</p>';</script><p>Second&nbsp;one &#8212; it ends here.<ul><li>Item</ul></main>"
        "<aside><p>Read also this other long article about something.</p></aside>"
        "<section id=comments><p>A reader writes a comment that is long as well.</p></section>"
        "<form><label>Mail</label><button>Send</button></form><footer><p>© 2020 Company. All rights reserved.</p></footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", page), (5, "u", "<p"), (6, "u", "<b><i></b></p></p>")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r.text for r in html_text.extract_text(frame).collect()}
    want = "Title & more First bold paragraph, with text that is long enough to read. Second one — it ends here. Item"
    assert got[1] == got[None] == want and got[2] == got[3] == got[6] == ""
    assert html_text.extract_text(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("inside", "kept"),
    [
        ('<svg class="i"/>', ""),
        ("<math/>", ""),
        ("<svg><title>Icon</title><path d='M0'/></svg>", ""),
        ("<svg/><svg><text>No</text></svg>", ""),
        ("<p>Area <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>", "Area x=2 holds. "),
        ("<template><p>No</p></template><iframe src='/a'>No</iframe><noframes>No</noframes>", ""),
        ("<svg>", ""),
        ("<template>", ""),
        ("<iframe src='/a'>", ""),
        ("<noembed>" * 3, ""),
        ("<svg-icon>", ""),
        ("<script>var a = '<p>no</p>';</script><style>p {}</style >", ""),
    ],
)
def test_elements_without_text_end_where_they_end(spark, inside, kept):
    page = f"<body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article>{inside}<p>Main text here, of a whole line or so.</p><p>More text, that ends here.</p></article></body>"
    got = html_text.leaf_blocks(page)
    assert " ".join(b.text for b in got) == f"Home {kept}Main text here, of a whole line or so. More text, that ends here."
    bare = html_text.leaf_blocks(page.replace(inside, ""))
    assert {b.above for b in got} <= {b.above for b in bare}
    frame = spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")
    assert html_text.extract_text(frame).first().text == f"{kept}Main text here, of a whole line or so. More text, that ends here."


def test_script_without_end_tag_goes_on_to_the_end():
    assert [b.text for b in html_text.leaf_blocks("<p>One</p><script>var a = '<p>no</p>'")] == ["One"]


def test_viterbi_equals_every_path():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 5, 2])
    scores, moves = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    start = 0
    for n, path in zip(lengths, crf.viterbi(scores, lengths, moves), strict=True):
        own = scores[start : start + n]
        value = lambda p: sum(own[t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))  # noqa: E731, B023
        assert value(path) == pytest.approx(max(map(value, itertools.product(range(3), repeat=int(n)))))
        start += n


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def passes(number):
        values = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(number))]
        return sum(v - 9 if v > 9 else v for v in values) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in ADDRESS.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [
        ("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and passes(digits(m.group()))
    ]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    pieces = ["a", "b.c", "@", "@x.y", ".", "-", " ", "+", "1", "23", "4.5", "255", "256", "(1)", "4111 1111 1111 1111", "é", "%", "_"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert personal_data.written(personal_data.base_spans(text)) == plain_spans(text), text


def test_added_spans(spark, nothing):
    texts = {
        1: "Please call 555-867-5309 tomorrow, or write jane (at) shop (dot) com now.",
        2: "Licensed under the Apache License, Version 2.0. In 2019 we sold 1,299 of 10-20 kinds.",
        3: "é mail x.y@mail.example.com and +1 (386) 555-3733 or 10.0.0.1",
        4: None,
        5: "",
        6: "9" * 5000 + " " + "a@" * 3000 + "1." * 4000,
    }
    frame = spark.createDataFrame(list(texts.items()), SCHEMA).withColumn("spans", F.lit("x"))
    got = {r.doc_id: r for r in personal_data.find_personal_data(frame).collect()}
    found = [texts[1][int(a) : int(b)] for _, a, b in (s.split(":") for s in got[1].spans.split(","))]
    assert "555-867-5309" in found and any("jane" in f and "com" in f for f in found)
    assert got[1].base == "" and got[2].spans == "" and got[3].spans == got[3].base == plain_spans(texts[3])
    assert got[4].spans == got[5].spans == "" and personal_data.find_personal_data(nothing).count() == 0


def test_malformed_pages_take_time_in_proportion():
    known = html_text.known_names(html_text.fitted())
    kinds = {
        "open tags": lambda n: "<a x " * n,
        "nested": lambda n: "<div>" * n,
        "nested with text": lambda n: "<div>t" * n,
        "classes": lambda n: "".join(f"<div class=c{i}>t" for i in range(n)),
        "stray quote": lambda n: "<a " * n + '">',
        "unmatched ends": lambda n: "</section>" * n,
        "ends behind a block": lambda n: "<i><div>" + "<b>" * n + "</i>" * n,
        "declarations": lambda n: "<!x " * n,
        "names": lambda n: "<a<a" * n,
        "raw ends": lambda n: "<svg>" + "</svg " * n,
        "quotes": lambda n: "<a \" '" * n,
    }

    def seconds(page):
        start = time.process_time()
        html_text.features(html_text.leaf_blocks(page, known))
        return time.process_time() - start

    for name, made in kinds.items():
        few = min(seconds(made(10_000)) for _ in range(2))
        assert seconds(made(80_000)) < 24 * max(few, 0.01), name


#: Layouts that are in no training page: (page, main text).
UNSEEN = [
    ("<body><div id=wrap><div class=masthead><a href=/>Home</a></div><div class=story-body><h1>Title one</h1><p>First long paragraph, with a comma and a stop.</p><p>Second one, as long as the first one was.</p></div><div class=related-links><ul><li><a href=/a>Other</a></li></ul></div></div></body>",
     "Title one First long paragraph, with a comma and a stop. Second one, as long as the first one was."),
    ("<body><nav><a href=/>Start</a><a href=/b>B</a></nav><main><section><h2>Head</h2><p>Text of a section, which is long enough to be text.</p><table><tr><th>Name</th><td>Value of it</td></tr></table></section></main><footer><p>Contact us, please.</p></footer></body>",
     "Head Text of a section, which is long enough to be text. Name Value of it"),
    ("<body><header>Site</header><article><h1>News</h1><figure><img src=x><figcaption>Caption of it.</figcaption></figure><p>Body of the news, in one paragraph of some length.</p><blockquote>Quoted words, said by somebody.</blockquote></article><aside class=promo><p>Buy this thing, now.</p></aside></body>",
     "News Caption of it. Body of the news, in one paragraph of some length. Quoted words, said by somebody."),
    ("<body><div class=topbar><ul><li><a href=/>One</a></li><li><a href=/2>Two</a></li></ul></div><div class=entry><p>An entry of a log, written by hand, with stops.</p><pre>code = 1</pre><p>And its end, as well.</p></div><div class=comments><p>Nice entry, thanks for it.</p></div></body>",
     "An entry of a log, written by hand, with stops. code = 1 And its end, as well."),
    ("<body><div role=navigation><a href=/>x</a></div><div role=main><h1>Guide</h1><ol><li>First step, do this.</li><li>Second step, do that.</li></ol></div><div role=contentinfo>© 2020 Somebody</div></body>",
     "Guide First step, do this. Second step, do that."),
    ("<body><div class=cookie-banner><p>We use cookies, as all do.</p><button>Accept</button></div><article><p>What the page is about, at some length.</p></article><form><label>Mail</label><input><button>Send</button></form></body>",
     "What the page is about, at some length."),
    ("<body><center><p>Old page, without any marks, but with text in it.</p><p>More of it, in a second paragraph.</p></center></body>",
     "Old page, without any marks, but with text in it. More of it, in a second paragraph."),
    ("<body><div id=header><h1>Blog</h1></div><div id=content><div class=post><h2>Post</h2><p>The post says this, and nothing else.</p></div></div><div id=sidebar><h3>Tags</h3><p>Some words on the side, too.</p></div><div id=footer>Imprint</div></body>",
     "Post The post says this, and nothing else."),
]


def test_unseen_layouts():
    """Precision and recall of words over layouts that were not trained on; README has the figures."""
    model = html_text.fitted()
    known = html_text.known_names(model)
    hit = found = wanted = 0
    for page, text in UNSEEN:
        blocks = html_text.leaf_blocks(page, known)
        (labels,) = model.decode([html_text.features(blocks)])
        got = Counter(" ".join(b.text for b, label in zip(blocks, labels.tolist(), strict=True) if label).split())
        want = Counter(text.split())
        hit += (got & want).total()
        found += got.total()
        wanted += want.total()
    print(f"precision {hit / found:.3f} recall {hit / wanted:.3f} of {wanted} words")
    assert hit / found >= 0.9 and hit / wanted >= 0.8


# Token files


def test_token_files(spark, docs, corpus, nothing, tmp_path):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.WORD_TOKENIZER)
    for encoding in ("dictionary", "delta"):
        folder = str(tmp_path / encoding)
        token_files.write_tokens(docs, folder, queries.WORD_TOKENIZER, 2, encoding, row_group_bytes=1 << 20)
        stored = token_files.read_tokens(spark, folder)
        got = token_files.token_digests(stored).collect()
        ends = sorted((r.start, r.start + r.n_tokens) for r in got)
        assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(ends))
        want = []
        for doc_id, text in corpus:
            ids = [*tool.encode(text or "", add_special_tokens=False).ids, 2]
            want.append((doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
        order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    many = spark.createDataFrame([(None if i % 3 else 4, f"text {i}") for i in range(300)], SCHEMA).repartition(6)
    got = token_files.write_and_read(many, queries.WORD_TOKENIZER, 2).collect()
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert len(got) == 300 and ends[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(ends))
    assert max(r.start for r in got if r.doc_id is None) < min(r.start for r in got if r.doc_id is not None)
    token_files.write_tokens(nothing, str(tmp_path / "none"), queries.WORD_TOKENIZER, 2)
    assert token_files.token_digests(token_files.read_tokens(spark, str(tmp_path / "none"))).count() == 0


def test_texts_are_encoded_together_by_their_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "PORTION_BYTES", 10)
    texts = pa.array(["aaaa", None, "bbbb", "é", "", "c" * 30, "dd", "eeeeeeee", "f"])
    assert list(token_files.portions(texts)) == [(0, 5), (5, 6), (6, 8), (8, 9)]
    assert list(token_files.portions(texts.slice(1, 2))) == [(0, 2)] and list(token_files.portions(texts.slice(0, 0))) == []


def test_small_batches_are_encoded_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "PORTION_BYTES", 10)
    texts = [["aaaa"], [None, "bb"], [], ["é", ""], ["c" * 30], ["dd"], ["eeeeeee", "f"], ["g"]]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(t, pa.string())}) for t in texts]
    got = [b.column("text").to_pylist() for b in token_files.gathered(iter(batches))]
    assert got == [["aaaa", None, "bb", "é", ""], ["c" * 30], ["dd", "eeeeeee", "f"], ["g"]]
    assert list(token_files.gathered(iter([]))) == []


def test_accented_words_are_spelt_as_the_library_does():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.WORD_TOKENIZER)
    words = token_files.WordTokens(queries.WORD_TOKENIZER)
    assert len(words.spelling) == 256
    chars = [chr(c) for c in range(0xDF, 0x100) if chr(c) != "÷"]
    texts = chars + [a + b for a in chars for b in ("a", "5", "é!", "...")] + ["7", "77", "!", "zoë", "été. été, Été"]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tool.encode(text, add_special_tokens=False).ids, repr(text)
    # Words met before, and new ones among them.
    again = [f"{t} neu{i} {t}" for i, t in enumerate(texts)]
    for text, ids in zip(again, words.encode(again), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tool.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_one_by_one_equal_whole_texts():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.WORD_TOKENIZER)
    rng = random.Random(7)
    pieces = ["The", " ", "  ", "\n", "\t", "'s", "0", "10", "<|endoftext|>", "é", "é", "́", "ΑΣ", "İ", "***", " ", " ", "x!"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(800)]
    got = token_files.WordTokens(queries.WORD_TOKENIZER).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tool.encode(text, add_special_tokens=False).ids, repr(text)


def test_commas_and_stops_stay_in_their_run():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.WORD_TOKENIZER)
    rng = random.Random(11)
    pieces = ["<|endoftext|>", "<|StartOfText|>", "<|startoftext|>", "Word", "next", "3", "_", ".", ",", ". ", ", ", "_. ", "_, ", "._", ",_", " ", "\n", "*", "^", "\x1c", "İ", "J", "\u030c", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(16))) for _ in range(3000)]
    texts += ["_word_. next", "name_, next", "\u0958, x", "J\u030c x", "H\u0323\u0331. x"]
    # Of CJK and Hangul letters a few stand for all.
    chars = [chr(i) for i in (*range(0x3500), *range(0xD700, 0xD800), *range(0xF900, 0x10000), *range(0x1D000, 0x1FC00))]
    texts += [f"a{c}{end}b" for c in chars for end in (", ", ". ")] + [f"J{c} x" for c in chars]
    got = token_files.WordTokens(queries.WORD_TOKENIZER).encode(texts)
    want = tool.encode_batch_fast(texts, add_special_tokens=False)
    for text, ids, whole in zip(texts, got, want, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == whole.ids, repr(text)


def test_plain_words_need_no_pipeline(monkeypatch):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.WORD_TOKENIZER)
    rng = random.Random(13)
    chars = [c for c in map(chr, [*range(0x21, 0x7F), *range(0xDF, 0x100)]) if token_files.WordTokens.PLAIN.fullmatch(c)]
    assert len(chars) == 26 + 10 + 31 + 32 and not {"'", "÷", "A"} & set(chars)
    texts = chars + ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    words = token_files.WordTokens(queries.WORD_TOKENIZER)
    assert words.direct
    asked = []
    monkeypatch.setattr(words, "one", asked.append)
    got = words.encode([*texts, " ".join(texts)])
    assert not asked
    want = tool.encode_batch_fast([*texts, " ".join(texts)], add_special_tokens=False)
    for text, ids, whole in zip([*texts, " ".join(texts)], got, want, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == whole.ids, repr(text)


# Repeated passages


def brute_repeats(rows, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = {}
    for own in split:
        for i in range(len(own) - length + 1):
            key = tuple(own[i : i + length])
            count[key] = count.get(key, 0) + 1
    out = []
    for (doc_id, _), own in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(own) - length + 1):
            if count[tuple(own[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((doc_id, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "gram"), [(35, 18), (6, 3), (5, 5)])
def test_repeated_windows_go(docs, corpus, length, gram, nothing):
    got = substring.remove_repeats(docs, length, gram).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute_repeats(corpus, length)
    for r in got:
        assert sum(b - a for a, b in r.intervals) == r.n_removed
    assert substring.remove_repeats(nothing, length, gram).count() == 0


def test_repeats_of_few_words(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(60)]
    got = substring.remove_repeats(spark.createDataFrame(rows, SCHEMA), 8, 4).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute_repeats(rows, 8)
