"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of key-like characters, long enough and not a plain word, or the value
of an assignment to a name like ``password``. Its features are the length, the shares and
transitions of character classes, the entropy, how much of it common words cover, whether it
looks like a path or address, and what the neighbouring words are. A random forest trained
on labelled findings gives every candidate of every document a probability; those below
``THRESHOLD`` are the false positives.

The forest is fitted on at most ``MAX_FINDINGS`` distinct labelled findings, those of smallest
hash, each weighted by how often it is there; candidates are found and judged in whole texts, all of them.

Defined cases. Null and blank texts have no candidates. Without findings of both kinds
nothing is removed: the probability is 1. Repeated rows give repeated findings. A null
doc_id stays null. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import texts
from tidegauge.llm.common import crc32_of, query, table
from tidegauge.session import staged

MIN_LENGTH = 8
MAX_FINDINGS = 20_000
THRESHOLD = 0.5
TREES, DEPTH, SEED = 24, 6, 5

_NAMES = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?"
_ASSIGNED = re.compile(rf"(?i)\b{_NAMES}[\"']?\s*(?:=|:|:=|=>)\s*[\"']?(?P<value>[^\s\"',;]{{6,}})")
_RUN = re.compile(rf"[A-Za-z0-9_+/=.@:\-]{{{MIN_LENGTH},}}")
_DIGIT = re.compile("[0-9]")
_NAME = re.compile(rf"(?i)\b{_NAMES}\W*$")

# Words that stand in paths, hosts, samples and placeholders.
_COMMON = re.compile(
    "example|sample|test|demo|mail|user|name|data|file|path|home|index|page|image|http|https|html|json|"
    "com|org|net|www|src|lib|bin|var|tmp|version|license|change|dummy|placeholder|changeme|password|secret"
)

FEATURES = [
    "length", "digits", "upper", "lower", "signs", "hex", "entropy", "transitions", "longest_run", "covered",
    "dots", "slashes", "at_sign", "dotted_number", "all_digits", "assigned", "named_before", "quoted", "after_space",
]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Disjoint candidate spans of a text, in order; an assignment's value goes first."""
    assigned = [m.span("value") for m in _ASSIGNED.finditer(text)]
    begins = [a for a, _ in assigned]
    runs = [m.span() for m in _RUN.finditer(text) if _DIGIT.search(m[0])]
    at = 0
    for start, end in sorted(assigned + runs, key=lambda s: (s[0], -s[1])):
        if start < at or bisect_right(begins, start) < bisect_left(begins, end):
            continue
        while end > start and text[end - 1] in ".:,=":
            end -= 1
        if end - start >= 6:
            yield start, end
            at = end


def _kind(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s"


def features(text: str, start: int, end: int) -> list[float]:
    value = text[start:end]
    size = len(value)
    kinds = [_kind(c) for c in value]
    share = Counter(kinds)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    longest = run = 1
    for a, b in zip(kinds, kinds[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    counts = Counter(value).values()
    before = text[max(0, start - 40) : start]
    return [
        float(size),
        share["d"] / size,
        share["u"] / size,
        share["l"] / size,
        share["s"] / size,
        sum(c in "0123456789abcdefABCDEF" for c in value) / size,
        -sum(n / size * math.log2(n / size) for n in counts),
        changes / size,
        longest / size,
        sum(len(m[0]) for m in _COMMON.finditer(value.lower())) / size,
        float(value.count(".")),
        float(value.count("/")),
        float("@" in value),
        float(re.fullmatch(r"\d+(\.\d+){2,}", value) is not None),
        float(share["d"] == size),
        float(before.rstrip("\"' ").endswith(("=", ":"))),
        float(_NAME.search(before) is not None),
        float(before.endswith(("'", '"'))),
        float(not before or before[-1].isspace()),
    ]


_FOUND = "doc_id bigint, start bigint, size bigint, digest string, features array<double>"


def scan(docs: DataFrame) -> DataFrame:
    """All candidates: doc_id, start, size, digest of the value and features."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(texts.column(batch, "doc_id"), texts.column(batch, "text")):
                for start, end in candidates(text or ""):
                    digest = sha256(text[start:end].encode()).hexdigest()
                    rows.append((doc_id, start, end - start, digest, features(text, start, end)))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND)


def judge(found: DataFrame, findings: DataFrame) -> DataFrame:
    """``found`` with ``probability`` and ``is_secret``.

    ``findings`` are labelled candidates: ``features`` and ``label``, 1 for a secret.
    """
    kinds = findings.filter("label IS NOT NULL").groupBy("features", "label").agg(F.count("*").cast("double").alias("weight"))
    used = kinds.orderBy(F.xxhash64("features"), "features", "label").limit(MAX_FINDINGS)
    used = staged(used.select(array_to_vector("features").alias("vector"), F.col("label").cast("double"), "weight"), "findings")
    if used.agg(F.count_distinct("label")).first()[0] < 2:
        return found.withColumns({"probability": F.lit(1.0), "is_secret": F.lit(True)})
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="p"
    )
    judged = forest.fit(used).transform(found.withColumn("vector", array_to_vector("features")))
    probability = F.get(vector_to_array("p"), 1)
    return judged.select(*found.columns, probability.alias("probability"), (probability >= THRESHOLD).alias("is_secret"))


def labelled_by_rule(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Findings with labels from documents, for tables that bring none.

    A value assigned to a credential name, or with the prefix and length of an access key
    of a known issuer, is a secret; addresses, dotted numbers, bare numbers and values with
    common words are not; the others have no label. Only documents whose CRC-32 modulo 3 is
    not 1 are used, the rest being for measurement.
    """
    used = found.filter(F.pmod(crc32_of("doc_id"), F.lit(3)) != 1)
    told = dict(zip(FEATURES, (F.get("features", i) for i in range(len(FEATURES)))))
    issued = (told["length"] == 20) & (told["upper"] + told["digits"] == 1) & (told["upper"] > 0)
    secret = (told["named_before"] == 1) | issued
    harmless = (told["at_sign"] == 1) | (told["dotted_number"] == 1) | (told["all_digits"] == 1) | (told["covered"] > 0.3)
    return used.select("features", F.when(secret, 1).when(harmless, 0).alias("label"))


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """All candidates of all texts, judged; ``is_secret`` tells those that stay."""
    found = staged(scan(docs), "candidates")
    return judge(found, labelled_by_rule(docs, found) if findings is None else findings)


@query("op5_secret_scan")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("features")
