"""Fingerprint likeness and language by compression, against plain loops over the same texts."""

import random

import pytest
import zstandard

from plumbline.llm import language, merkle

WORDS = {
    "en": "the and of water house green street when people river morning with under small",
    "de": "der und das wasser haus grün straße wenn leute fluss morgen mit unter klein",
    "es": "el y de agua casa verde calle cuando gente río mañana con bajo pequeño",
}


def texts(count, seed):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        lang = rng.choice(sorted(WORDS))
        lines = [" ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(14))) for _ in range(rng.randrange(1, 25))]
        out.append((i, "\n".join(lines), lang))
    out += [(count, out[0][1], "en"), (count + 1, "", "de"), (count + 2, None, "es"), (count + 3, "a\n\n\U0001f600" * 40, None)]
    return out


def leaves(text):
    return {line[i : i + merkle.BLOCK] for line in text.split("\n") for i in range(0, len(line), merkle.BLOCK)}


def plain_likeness(one, other):
    a, b = leaves(one), leaves(other)
    return 1.0 if one == other else 2 * len(a & b) / max(len(a) + len(b), 1)


def test_likeness_equals_shared_leaves(spark):
    corpus = {i: text or "" for i, text, _ in texts(60, 4)}
    frame = spark.createDataFrame([(i, t) for i, t in corpus.items()], "doc_id bigint, text string")
    ids = sorted(corpus, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    got = merkle.compare_with_next(frame).collect()
    assert sorted(r.doc_id for r in got) == sorted(corpus)
    for r in got:
        own, following = corpus[r.doc_id], corpus[after[r.doc_id]]
        k = len(own) // 3
        edited = own[: len(own) - k] + following[:k]
        assert r.edited == edited
        assert r.near_edited == pytest.approx(plain_likeness(own, edited))
        assert r.near_next == pytest.approx(plain_likeness(own, following))


def plain_sizes(dictionaries, body):
    """Compressed bytes with each dictionary, a fresh compressor for every block."""
    out = []
    for raw in dictionaries.values():
        parameters = zstandard.ZstdCompressionParameters.from_level(
            3, source_size=language.BLOCK, dict_size=len(raw), strategy=zstandard.STRATEGY_LAZY2, min_match=language.MIN_MATCH,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        size = 0
        for start in range(0, len(body), language.BLOCK):
            shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=parameters)
            tool = zstandard.ZstdCompressor(dict_data=shared, compression_params=parameters)
            size += len(tool.compress(body[start : start + language.BLOCK]))
        out.append(size)
    return out


def test_language_equals_a_plain_loop(spark):
    labelled = spark.createDataFrame(texts(120, 5), "doc_id bigint, text string, lang string")
    dictionaries = language.fit_dictionaries(labelled)
    corpus = [(i, t) for i, t, _ in texts(80, 6)] + [(500, " ".join(WORDS["de"].split() * 3000)), (501, "123 456")]
    frame = spark.createDataFrame(corpus, "doc_id bigint, text string")
    got = {r.doc_id: r for r in language.predict_language(frame, dictionaries).collect()}
    names = list(dictionaries)
    assert sorted(names) == sorted(WORDS) and len(got) == len(corpus)
    for doc_id, text in corpus:
        body = language.letters(text or "").encode()
        row = got[doc_id]
        if not body:
            assert (row.lang_pred, row.score, row.told) == (language.UNKNOWN, 0.0, False)
            continue
        sizes = plain_sizes(dictionaries, b" " + body + b" ")
        best, second = sorted(sizes)[:2]
        assert row.lang_pred == names[sizes.index(best)]
        assert row.score == pytest.approx(1 - best / second)
        assert row.told == (second > best and second - best >= language.MARGIN * best)
