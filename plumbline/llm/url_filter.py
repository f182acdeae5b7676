"""URL filters by a sorted digest array.

The strings of a filter list (hosts that have rules, rules, words) are stored by their 64-bit xxhash
in one sorted array, which each worker maps into memory; pages are never shuffled. Batches of
candidate strings are hashed and found by binary search, and the stored string itself is compared,
so that a collision of digests never counts as a match.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import binaries, lowered, scratch, small_batches

ALLOW, BLOCK = "allow", "block"
#: A filter list of more bytes is refused: every worker machine holds one copy of it.
MAX_BYTES = 1 << 28
#: Words of a host name that block it where no rule fits: common names of adult, gambling, drug and
#: piracy sites. A parameter of ``judge_urls``.
WORDS = (
    "adult bet bets betting casino casinos cialis escort escorts gambling hentai pills poker porn porno sex slots "
    "torrent torrents viagra warez xxx"
).split()
WORD = re.compile(rb"[^\x00-/:-@\[-`{-\x7f]+")
#: The list is read with this many bytes a step when it is put into the shared folder.
STEP = 1 << 20


def digests(strings: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, strings), dtype=np.uint64, count=len(strings))


class DigestArray:
    """String to values, sorted by digest; equal strings may have several values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, ends: np.ndarray, body: np.ndarray):
        self.keys, self.values, self.ends, self.body = keys, values, ends, body

    @staticmethod
    def parts(entries: Iterable[tuple[bytes, int]], digest=digests) -> list[np.ndarray]:
        """keys, values, ends and body of a list; ``digest`` is another only in the test of collisions."""
        entries = sorted(set(entries))
        keys = digest([text for text, _ in entries])
        order = np.argsort(keys, kind="stable")
        texts = [entries[i][0] for i in order.tolist()]
        values = np.array([entries[i][1] for i in order.tolist()], dtype=np.int64)
        ends = np.cumsum([0, *map(len, texts)]).astype(np.int64)
        return [keys[order], values, ends, np.frombuffer(b"".join(texts), dtype=np.uint8)]

    def find(self, strings: list[bytes], digest=digests) -> tuple[np.ndarray, np.ndarray]:
        """(number of the string, value) of every stored string that is equal to one asked for."""
        keys = digest(strings)
        low = np.searchsorted(self.keys, keys, side="left")
        count = np.searchsorted(self.keys, keys, side="right") - low
        asked = np.repeat(np.arange(len(strings)), count)
        place = np.arange(len(asked)) - np.repeat(np.cumsum(count) - count, count) + low[asked]
        # Most digests that meet belong to one string; the strings decide.
        same = np.array(
            [
                self.body[self.ends[at] : self.ends[at + 1]].tobytes() == strings[i]
                for i, at in zip(asked.tolist(), place.tolist(), strict=True)
            ],
            dtype=bool,
        )
        return asked[same], np.asarray(self.values[place[same]])


def packed(lists: dict[str, list[tuple[bytes, int]]]) -> bytes:
    """Digest arrays in one file: a line that says where each part lies, then the parts."""
    body, where = [], {}
    at = 0
    for name, entries in lists.items():
        where[name] = []
        for part in DigestArray.parts(entries):
            raw = part.tobytes()
            raw += b"\0" * (-len(raw) % 8)
            where[name].append((part.dtype.str, at, len(part)))
            body.append(raw)
            at += len(raw)
    head = json.dumps({"lists": where, "longest": {n: max((len(t) for t, _ in e), default=-1) for n, e in lists.items()}}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(body)


class Filter:
    """The arrays of a packed file, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            head = file.readline()
        told = json.loads(head)
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        self.longest = told["longest"]
        self.lists = {
            name: DigestArray(*(np.frombuffer(raw, np.dtype(kind), count, len(head) + at) if count else np.empty(0, kind) for kind, at, count in parts))
            for name, parts in told["lists"].items()
        }

    def suffixes(self, host: bytes) -> list[bytes]:
        """The host and those it is a subdomain of, no longer than the longest that has rules."""
        longest = self.longest["hosts"]
        found = [host] if len(host) <= longest else []
        at = host.find(b".", max(0, len(host) - longest - 1))
        while at >= 0:
            found.append(host[at + 1 :])
            at = host.find(b".", at + 1)
        return found

    def rules(self, hosts: list[bytes], paths: list[bytes]) -> list[tuple[bytes, int] | None]:
        """(rule, verdict) of each url, or None. The longest rule wins, of equally long ones that of the longer host."""
        known: dict[bytes, list[tuple[bytes, int]]] = {host: [] for host in hosts}
        above = [(host, own) for host in known for own in self.suffixes(host)]
        for at, length in zip(*(x.tolist() for x in self.lists["hosts"].find([own for _, own in above])), strict=True):
            known[above[at][0]].append((above[at][1], length))
        asked: list[bytes] = []
        owner: list[tuple[int, int, int]] = []
        for number, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for own, length in known[host]:
                if length <= len(path):
                    asked.append(own + b"\n" + path[:length])
                    owner.append((number, len(own) + length, len(own)))
        best: list[tuple[int, int, bytes, int] | None] = [None] * len(hosts)
        for at, verdict in zip(*(x.tolist() for x in self.lists["rules"].find(asked)), strict=True):
            number, length, own = owner[at]
            found = (length, own, asked[at], verdict)
            if best[number] is None or found[:2] > best[number][:2]:
                best[number] = found
        return [None if b is None else (b[2].replace(b"\n", b"", 1), b[3]) for b in best]

    def worded(self, hosts: list[bytes]) -> list[bool]:
        """Whether a word of the host is in the list."""
        longest = self.longest["words"]
        asked = {host: [w for w in WORD.findall(host) if len(w) <= longest] for host in set(hosts)}
        words = list({w for own in asked.values() for w in own})
        listed = {words[i] for i in self.lists["words"].find(words)[0].tolist()}
        return [any(w in listed for w in asked[host]) for host in hosts]


@functools.lru_cache(maxsize=4)
def opened(name: str) -> Filter:
    return Filter(SparkFiles.get(name))


def shared_file(spark: SparkSession, body: bytes, label: str) -> str:
    """Put ``body`` into the shared folder and have Spark copy it to each executor that needs it; gives its name.

    Executors that join later, or anew, fetch it from the shared folder as well. The name holds its digest, so the
    same list is put there once a session.
    """
    context = spark.sparkContext
    name = f"{label}-{hashlib.sha256(body).hexdigest()[:24]}.bin"
    if any(path.rstrip("/").endswith(name) for path in context.listFiles):
        return name
    path = context._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark, label)}/{name}")
    out = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path, True)
    try:
        for start in range(0, len(body), STEP):
            out.write(bytearray(body[start : start + STEP]))
    finally:
        out.close()
    context.addFile(path.toString())
    return name


def filter_file(spark: SparkSession, rules: DataFrame, words: Iterable[str] = WORDS) -> str:
    """The packed list of ``rules`` (host, path, verdict) and ``words``, shared with the executors.

    Hosts and words are lowered (A-Z). Null hosts and paths are empty; a rule without verdict blocks;
    of the same rule with both verdicts the blocking one holds. Lists above ``MAX_BYTES`` are refused
    before they are read.
    """
    clean = rules.select(
        lowered(F.coalesce(F.col("host"), F.lit(""))).alias("host"),
        F.coalesce(F.col("path"), F.lit("")).alias("path"),
        (F.coalesce(F.col("verdict"), F.lit(BLOCK)) != ALLOW).cast("int").alias("blocks"),
    )
    clean = clean.groupBy("host", "path").agg(F.max("blocks").alias("blocks"))
    words = [w.encode() for w in words]
    size = clean.agg(F.sum(F.octet_length("host") * 2 + F.octet_length("path") + 80)).first()[0] or 0
    if size + sum(map(len, words)) > MAX_BYTES:
        raise ValueError(f"a filter list of {size} bytes is over the bound of {MAX_BYTES}")
    rows = [(r.host.encode(), r.path.encode(), r.blocks) for r in clean.collect()]
    lists = {
        "hosts": [(host, len(path)) for host, path, _ in rows],
        "rules": [(host + b"\n" + path, blocks) for host, path, blocks in rows],
        "words": [(w.lower(), 1) for w in words],
    }
    return shared_file(spark, packed(lists), "url-filter")


JUDGED = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
HOST_AND_PATH = "://([^/?#]*)([^?#]*)"


def judge_urls(
    pages: DataFrame, rules: DataFrame, words: Iterable[str] = WORDS, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Per row: page_id, host, path, rule (null if none fits), verdict.

    The host is what follows the first ``://`` up to ``/``, ``?`` or ``#``, with A-Z lowered; the path is
    what follows it up to ``?`` or ``#``. A null url, or one without ``://``, has neither and is allowed
    unless a rule of the empty host and path says otherwise. A rule fits its host and all subdomains if
    the path starts with its own; the longest rule wins. Without a rule a url is blocked if a word of
    its host is in ``words`` and allowed otherwise. Rows are judged on their own, so repeated ones and
    those without identifier come back; an empty table gives an empty result.
    """
    name = filter_file(pages.sparkSession, rules, words)
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = opened(name)
        for batch in batches:
            hosts, paths = binaries(batch.column("host")), binaries(batch.column("path"))
            fitting = listed.rules(hosts, paths)
            blocked = [
                bool(rule[1]) if rule else worded for rule, worded in zip(fitting, listed.worded(hosts), strict=True)
            ]
            told = [rule[0].decode() if rule else None for rule in fitting]
            columns = [
                *(batch.column(c) for c in ("page_id", "host", "path")),
                pa.array(told, pa.string()),
                pa.array([BLOCK if b else ALLOW for b in blocked], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=JUDGED)

    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    picked = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"),
        lowered(F.regexp_extract(url, HOST_AND_PATH, 1)).alias("host"),
        F.regexp_extract(url, HOST_AND_PATH, 2).alias("path"),
    )
    return picked.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")
