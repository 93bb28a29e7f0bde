"""Secret scans with a random forest that removes false positives (operator 7).

A pattern proposes candidates: long runs of key-like characters.  A random forest,
trained here in numpy from labelled findings, decides on each from its length, the
transitions between character classes, the share that dictionary words cover, the
document's path and the neighbouring words.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

#: Labelled findings that training looks at, at most; trees, their depth, and the
#: share of votes from which a candidate counts as a secret.
TRAINING, TREES, DEPTH, VOTES = 6_000, 30, 10, 0.5
#: Characters of context on each side of a candidate.
LEFT, RIGHT = 32, 16

CANDIDATE = re.compile(r"[A-Za-z0-9_+/\-]{14,}={0,2}")
SECRET_WORDS = re.compile(r"(?i)(pass(word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|private|credential|auth|bearer|aws)\W{0,4}$|(?i:key)\W{0,4}$")
PLAIN_WORDS = re.compile(r"(?i)\b(commit|sha\d*|md5|checksum|digest|uuid|guid|card|phone|tel|isbn|order|invoice|version|build|revision|example|hash|etag|integrity)\W{0,4}$")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk-", "sk_", "pk_", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-", "npm_")
TEST_PATH = re.compile(r"(?i)(^|[/_.-])(test|tests|spec|example|examples|fixture|fixtures|doc|docs|sample)s?([/_.-]|$)")
#: Common words whose presence speaks against a random string.
DICTIONARY = frozenset(
    """about access account action active after agent algorithm all also and any application array base before
    best blue body book build button cache call case center change check class client code color column common
    component config connection content context control copy count create current data database date debug default
    delete description detail device digital document domain down each element email engine entry error event
    example export face factory false feature field file filter find first float folder font for form format
    from function general global graph green group hash have head header height home host http icon image import
    index info input integer interface internal item java javascript key language large last layout left level
    library license light line link list load local location login long main management manager map master max
    media memory menu message method middle model module more mouse move name native network new next node none
    normal not null number object only open option order other output over package page panel parent part password
    path people phone place point port position post press print process product profile program project property
    public query question random range read red ref release remove report request reset resource response result
    return right root row rule run sample save scale screen script search second section select self send server
    service session set setting shape share show sign simple single site size small sort source space spec split
    standard start state static status stop storage store stream string style submit support switch system table
    tag target task template test text that the then thing this thread time title token tool top total track
    transform tree true type under unit update upload url user value variable vector version video view visible
    web week when white width window with word work world write year zone""".split()
)
NAMES = (
    "length", "digits", "upper", "lower", "symbols", "class_changes", "case_changes", "dictionary", "distinct", "entropy",
    "hex", "all_digits", "assigned", "quoted", "secret_word", "plain_word", "test_path", "prefix", "groups",
)


def dictionary_cover(text: str) -> float:
    """Share of the characters that dictionary words of 3 to 12 letters cover."""
    low, n, end, covered = text.lower(), len(text), 0, 0
    at = 0
    while at < n:
        for size in range(min(12, n - at), 2, -1):
            if low[at : at + size] in DICTIONARY:
                covered += at + size - max(at, end)
                end = at + size
                break
        at = max(at + 1, end) if end > at else at + 1
    return covered / max(1, n)


def kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def features(candidate: str, left: str, right: str, path: str) -> list[float]:
    n = max(1, len(candidate))
    kinds = [kind_of(c) for c in candidate]
    share = [kinds.count(k) / n for k in range(4)]
    pairs = list(zip(kinds, kinds[1:], strict=False))
    counts = Counter(candidate)
    return [
        float(n), *share,
        sum(a != b for a, b in pairs) / max(1, n - 1),
        sum({a, b} == {1, 2} for a, b in pairs) / max(1, n - 1),
        dictionary_cover(candidate),
        len(counts) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        float(all(c in "0123456789abcdefABCDEF" for c in candidate)),
        float(candidate.isdigit()),
        float(bool(re.search(r"[=:]\s*['\"]?$", left))),
        float(left[-1:] in "'\"" and bool(left)),
        float(bool(SECRET_WORDS.search(left))),
        float(bool(PLAIN_WORDS.search(left))),
        float(bool(TEST_PATH.search(path))),
        float(candidate.startswith(PREFIXES)),
        float(len(re.split(r"[-_/+]", candidate))),
    ]


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH + 1):
            f = self.feature[at]
            down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, down)
        return self.value[at]


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Tree:
    """One tree: at each node the split of least Gini impurity among random features."""
    nodes: list[list] = []

    def add(rows: np.ndarray, depth: int) -> int:
        own = len(nodes)
        share = y[rows].mean()
        nodes.append([-1, 0.0, own, own, share])
        if depth == DEPTH or len(rows) < 4 or share in (0.0, 1.0):
            return own
        best = (2.0, -1, 0.0)
        for f in rng.choice(x.shape[1], max(2, round(math.sqrt(x.shape[1]))), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, hits = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if len(cut):
                a, n = hits[cut - 1], len(rows)
                b = hits[-1] - a
                gini = (a * (1 - a / cut) + b * (1 - b / (n - cut))) / n
                i = gini.argmin()
                best = min(best, (float(gini[i]), int(f), float((v[cut[i]] + v[cut[i] - 1]) / 2)))
        if best[1] >= 0:
            goes = x[rows, best[1]] <= best[2]
            nodes[own][:2] = best[1:]
            nodes[own][2] = add(rows[goes], depth + 1)
            nodes[own][3] = add(rows[~goes], depth + 1)
        return own

    add(rng.integers(0, len(x), len(x)), 0)
    columns = list(zip(*nodes, strict=True))
    return Tree(*(np.array(c, k) for c, k in zip(columns, (np.int64, float, np.int64, np.int64, float), strict=True)))


@dataclass
class Forest:
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)


def train(findings: list[tuple[str, str, str, str, int]], seed: int = 11) -> Forest:
    """A forest from labelled findings (candidate, left, right, path, 1 for a secret)."""
    rng = np.random.default_rng(seed)
    x = np.array([features(*f[:4]) for f in findings[:TRAINING]])
    y = np.array([f[4] for f in findings[:TRAINING]], float)
    return Forest([grow(x, y, rng) for _ in range(TREES)])


def labelled_findings(n: int = 4_000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings for training where no reviewed ones are at hand: secrets of
    known formats in assignments and prose, and look-alikes (card and phone numbers,
    identifiers, digests named as such, paths, long words)."""
    rng = random.Random(seed)
    pick = lambda alphabet, size: "".join(rng.choice(alphabet) for _ in range(size))
    hexes, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syllables = "an er th on re in the ti or ed ou st ea ha sh ing tion wh ly ble ver ge sch ung heit ción mente que aux oi".replace("ó", "o").split()
    words = sorted(DICTIONARY)
    made = []
    for i in range(n):
        prose = f"{rng.choice(words)} {pick(string.ascii_lowercase, rng.randint(2, 9))} "
        path = rng.choice(["src3", "src12", "app/main.py", "config/settings.yml", "tests/data.txt", "docs/readme.md"])
        if i % 2:
            name = rng.choice(["token", "password", "passwd", "secret", "api_key", "access_key", "auth", "private_key", "client_secret", "key"])
            sign = rng.choice([" = \"", "=", ": ", ": '", " = "])
            value, free = rng.choice([
                (pick(hexes, rng.choice([16, 18, 20, 24, 32, 40, 48, 64])), False),
                (pick(alnum, rng.randint(16, 48)), False),
                (pick(b64, rng.choice([40, 43, 64])) + rng.choice(["", "=", "=="]), False),
                (rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16), True),
                (rng.choice(["ghp_", "gho_", "ghs_"]) + pick(alnum, 36), True),
                (rng.choice(["sk-", "sk_live_", "pk_live_"]) + pick(alnum, rng.choice([24, 32, 48])), True),
                (rng.choice(["xoxb-", "xoxp-"]) + pick(string.digits, 12) + "-" + pick(alnum, 24), True),
                ("AIza" + pick(alnum + "_-", 35), True),
                ("eyJ" + pick(alnum, rng.randint(20, 80)), True),
            ])
            left = prose if free and rng.random() < 0.5 else prose + name + sign
            made.append((value, left[-LEFT:], rng.choice(["\"", "'", " ", "\n"]) + prose[:8], path, 1))
        else:
            value, left = rng.choice([
                (pick(string.digits, rng.choice([14, 15, 16, 16, 18])), prose),
                (pick(string.digits, 16), prose + rng.choice(["card ", "order ", "invoice: ", "isbn ", "phone "])),
                ("-".join(pick(string.digits, rng.choice([3, 4])) for _ in range(4)), prose),
                ("-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), prose + rng.choice(["uuid ", "guid=", "id ", ""])),
                (pick(hexes, rng.choice([32, 40, 64])), prose + rng.choice(["commit ", "sha256:", "md5 ", "checksum = ", "digest: ", "etag \""])),
                ("_".join(rng.choice(words) for _ in range(rng.randint(3, 6))) + rng.choice(["", "_2", "_v1", "_01"]), prose),
                ("/".join(rng.choice(words) for _ in range(rng.randint(3, 6))) + rng.choice(["", "/2024", "/v2"]), prose),
                ("-".join(rng.choice(words) for _ in range(3)) + f"-20{pick(string.digits, 2)}-0{pick(string.digits, 1)}", prose),
                ("".join(rng.choice(syllables) for _ in range(rng.randint(5, 11))), prose),
                ("".join(rng.choice(syllables) for _ in range(rng.randint(5, 9))) + pick(string.digits, rng.randint(1, 2)), prose),
                ("".join(rng.choice(words).title() for _ in range(rng.randint(3, 5))) + rng.choice(["", "2", "V3"]), prose),
                (rng.choice(["-", "_", "/", "+"]) * rng.randint(14, 40) + rng.choice(["", "1", "2024"]), prose),
                (f"20{pick(string.digits, 2)}-0{pick(string.digits, 1)}-1{pick(string.digits, 1)}T{pick(string.digits, 6)}", prose),
            ])
            made.append((value, left[-LEFT:], " " + prose[:8], path, 0))
    return made


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs that hold a digit, or upper and lower case mixed at random."""
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if not s.isalpha() and any(c.isdigit() for c in s) or len(s) >= 20 and sum(a.islower() and b.isupper() for a, b in zip(s, s[1:], strict=False)) >= 3:
            yield m.span()


def found_in(text: str, path: str, forest: Forest) -> list[tuple[int, int, float]]:
    spans = list(candidates(text))
    if not spans:
        return []
    x = np.array([features(text[a:b], text[max(0, a - LEFT) : a], text[b : b + RIGHT], path) for a, b in spans])
    return [(a, b, float(v)) for (a, b), v in zip(spans, forest.predict(x), strict=True) if v >= VOTES]


def findings(docs: DataFrame, forest: Forest, path: str = "source") -> DataFrame:
    """(doc_id, start, stop, votes, sha256): a row for each secret, in code points of
    the text; the secret itself is not returned.

    Null and empty texts have none, a null path is an empty one, repeated rows give
    repeated findings.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("votes", T.DoubleType()), T.StructField("sha256", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for start, texts in text_slices(batch, "text"):
                for i, raw in enumerate(texts):
                    text = raw.decode("utf-8", "replace")
                    for a, b, v in found_in(text, batch.column(2)[start + i].as_py() or "", shared.value):
                        rows.append((batch.column(0)[start + i].as_py(), a, b, v, hashlib.sha256(text[a:b].encode()).hexdigest()))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(path).cast("string").alias("path")).mapInArrow(run, schema)


def redacted(docs: DataFrame, forest: Forest, path: str = "source", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the same rows and columns, secrets in ``text`` replaced by
    ``mask``.  Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    names = docs.columns
    at_path = names.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            old, out = batch.column(at), []
            for start, texts in text_slices(batch, "text"):
                for i, raw in enumerate(texts):
                    text = raw.decode("utf-8", "replace")
                    for a, b, _ in reversed(found_in(text, batch.column(at_path)[start + i].as_py() or "", shared.value)):
                        text = text[:a] + mask + text[b:]
                    out.append(text if old[start + i].is_valid else None)
            yield batch.set_column(at, names[at], pa.array(out, old.type))

    return docs.mapInArrow(run, docs.schema)
