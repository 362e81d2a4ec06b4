"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

All of it is DataFrame functions: candidates are cut out of the text with one pattern, described by
numbers (length, changes between kinds of characters, share covered by dictionary words, signs of a
path, neighbouring words), and judged by a forest that is trained on labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.sources.durable import durable, release

# Characters of the text before and after a candidate in which neighbouring words are looked for.
BEFORE, AFTER = 48, 24
# Characters from the start of a candidate to that of the next, at least: a credential's word and a sign.
SPAN = 4
# Labelled findings of each class that the forest is trained on, at most.
FINDINGS_PER_CLASS = 5000
TREES, DEPTH, SEED = 40, 6, 11

# Words that name a credential, and words that name something else, beside a candidate.
CREDENTIAL_WORDS = r"(?i)(passw(or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential)"
OTHER_WORDS = r"(?i)(example|sample|dummy|test|card|phone|isbn|order|commit|sha|checksum|version)"
# How issuers write their keys.
ISSUER_KEYS = (
    r"AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abpr]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}"
    r"|sk_live_[0-9A-Za-z]{16,}"
)
ISSUED = rf"^({ISSUER_KEYS})$"

# An issuer's key with edges of its own: '/', '-', '_' or '+' may stand beside it.
_KEY = rf"(?<![A-Za-z0-9])(?:{ISSUER_KEYS})(?![A-Za-z0-9])"
# What a value that follows a credential's name and an assignment sign ends at.
_STOP = r"\s\"'`,;&<>(){}\[\]|"
# Such a name and sign, at most 45 characters; 'Author:' names none. The short test first: it fails fast.
_NAME = (
    r"(?<=[=:][ \t]{0,4}[\"']?)"
    r"(?<=(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?!or(?!i[sz]))|bearer|credential)"
    r"[^\s=:]{0,24}[ \t]{0,4}[=:]{1,2}[ \t]{0,4}[\"']?)"
)
# An issuer's key; a value of any characters and length behind a credential's name, without what ends a
# sentence; or a run of at least twelve letters, digits and signs of encodings, with a digit, not cut out of
# a longer one. A key ends the others, and what follows it in its run (\G) may be a candidate again.
CANDIDATE = (
    rf"{_KEY}"
    rf"|{_NAME}(?![=:]|//)(?:(?!{_KEY}|[.:?]+(?:[{_STOP}]|$))[^{_STOP}])++"
    r"|(?:(?<![A-Za-z0-9+/_-])|\G)(?=[A-Za-z+/_-]*[0-9])"
    rf"(?:(?!{_KEY})[A-Za-z0-9+/_-]){{12,}}+"
)

FEATURES = [
    "length", "transitions", "dictionary", "digits", "upper", "distinct_share", "hex_only", "in_path",
    "assigned", "quoted", "credential_near", "other_near",
]


def _share(value: Column, pattern: str) -> Column:
    rest = F.regexp_replace(value, pattern, "")
    return F.lit(1.0) - F.length(rest) / F.length(value)


def _attributes(rows: DataFrame, **columns: Column) -> DataFrame:
    """``doc_id`` and these columns, computed once a row: lambdas would compute inlined ones for each element."""
    return rows.select("doc_id", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def findings(documents: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``doc_id``, ``place`` (from 0), ``candidate`` and the features of each candidate of each text.

    ``dictionary`` has ``word`` (lower case, each once). Null and empty texts have no candidates.
    Each row of a repeated text gives its own findings. Patterns run over the whole text.
    """
    cut = _attributes(
        documents,
        found=F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)),
        gaps=F.split("text", CANDIDATE, -1),
    ).where(F.size("found") > 0)
    # Gap i is before candidate i, gap i + 1 after it. What a context needs of a gap and the candidate behind
    # it are its ends; texts of any number of candidates take a fixed number of pieces for each.
    pieces = F.zip_with("gaps", "found", lambda g, f: F.concat(g, F.coalesce(f, F.lit(""))))
    ends = _attributes(
        cut,
        found=F.col("found"),
        gap_tails=F.transform("gaps", lambda g: F.right(g, F.lit(BEFORE))),
        tails=F.transform(pieces, lambda p: F.right(p, F.lit(BEFORE))),
        heads=F.transform(pieces, lambda p: F.left(p, F.lit(AFTER))),
    )

    def before(_: Column, i: Column) -> Column:
        n = F.least(i, F.lit(-(-BEFORE // SPAN)))
        earlier = F.array_join(F.slice("tails", i - n + 1, n), "")
        return F.right(F.concat(earlier, F.get("gap_tails", i)), F.lit(BEFORE))

    def after(_: Column, i: Column) -> Column:
        return F.left(F.array_join(F.slice("heads", i + 2, F.lit(1 - -AFTER // SPAN)), ""), F.lit(AFTER))

    each = F.arrays_zip(
        F.col("found").alias("candidate"),
        F.transform("found", before).alias("before"),
        F.transform("found", after).alias("after"),
    )
    rows = ends.select("doc_id", F.posexplode(each).alias("place", "f")).select(
        "doc_id",
        F.col("place").cast("long").alias("place"),
        F.col("f.candidate").alias("candidate"),
        F.col("f.before").alias("before"),
        F.col("f.after").alias("after"),
    )
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        F.regexp_replace("candidate", "[a-z]+", "l"), "[A-Z]+", "u"), "[0-9]+", "0"), "[+/_-]+", "s")
    described = rows.select(
        "*",
        F.length("candidate").cast("double").alias("length"),
        ((F.length(kinds) - 1) / F.greatest(F.length("candidate") - 1, F.lit(1))).alias("transitions"),
        _share(F.col("candidate"), "[0-9]").alias("digits"),
        _share(F.col("candidate"), "[A-Z]").alias("upper"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate")).alias("distinct_share"),
        F.col("candidate").rlike("^[0-9a-f]+$").cast("double").alias("hex_only"),
        (F.col("before").rlike(r"(://|[./\\@])[^\s]*$") | F.col("candidate").rlike("/.*/")).cast("double").alias("in_path"),
        F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double").alias("assigned"),
        (F.col("before").rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")).cast("double").alias("quoted"),
        F.col("before").rlike(CREDENTIAL_WORDS + r"[^\s]*\s*[=:]?\s*[^\s]*$").cast("double").alias("credential_near"),
        (F.col("before").rlike(OTHER_WORDS) | F.col("after").rlike(OTHER_WORDS)).cast("double").alias("other_near"),
    )
    # Stored: the patterns over whole texts run once, however often the rows are read.
    stored = durable(described)
    found = durable(_with_dictionary(stored, dictionary))
    release(stored)
    return found


def _with_dictionary(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds ``dictionary``, the share of the candidate that is runs of letters which are words."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{4,}"), F.lit(0)))
    distinct = rows.select("candidate").distinct().select("candidate", F.explode(runs).alias("word"))
    covered = (
        distinct.join(dictionary.select("word"), "word")
        .groupBy(F.col("candidate").alias("_candidate")).agg(F.sum(F.length("word")).alias("_covered"))
    )
    joined = rows.join(covered, F.col("candidate") == F.col("_candidate"), "left")
    share = F.least(F.coalesce("_covered", F.lit(0)) / F.length("candidate"), F.lit(1.0))
    return joined.withColumn("dictionary", share).drop("_candidate", "_covered")


def rule_label() -> Column:
    """Column: the label of findings that rules decide, else null.

    1: written as an issuer writes its keys, or assigned to a name for a credential. 0: digits only,
    or part of a path or address, or mostly dictionary words. Dictionary words without a digit and whole
    addresses behind a credential's name ("password: required") may be either and are left to the forest.
    """
    named = F.col("assigned") + F.col("credential_near") == 2
    plain = (F.col("digits") == 0) & (F.col("dictionary") > 0.5)
    open_case = named & (plain | F.col("candidate").contains("://"))
    issued = F.col("candidate").rlike(ISSUED)
    other = (F.col("digits") == 1) | (F.col("in_path") == 1) | (F.col("dictionary") > 0.5)
    return F.when(issued, 1.0).when(open_case, None).when(named, 1.0).when(other, 0.0)


def train(labelled: DataFrame) -> RandomForestClassificationModel | None:
    """A forest from findings with ``label``: per class the first ``FINDINGS_PER_CLASS`` by hash.

    None where one class is missing. The bound holds at every size.
    """
    drawn = None
    for label in (0.0, 1.0):
        part = (
            labelled.where(F.col("label") == label).select("label", "candidate", *FEATURES).distinct()
            .orderBy(F.xxhash64("candidate"), "candidate", *FEATURES).limit(FINDINGS_PER_CLASS)
        )
        drawn = part if drawn is None else drawn.unionByName(part)
    drawn = durable(drawn)
    if drawn.select("label").distinct().count() < 2:
        release(drawn)
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    model = forest.fit(_assembled(drawn).select("label", "features"))
    release(drawn)
    return model


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def judge(rows: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """The findings with ``probability`` that they are secrets; what rules say where there is no model."""
    if model is None:
        return rows.withColumn("probability", F.coalesce(rule_label(), F.lit(0.0)))
    scored = model.transform(_assembled(rows))
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "prediction"
    )


def scan_secrets(
    documents: DataFrame,
    dictionary: DataFrame,
    learn_from: Column,
    limit: float = 0.5,
    labelled: DataFrame | None = None,
) -> DataFrame:
    """``doc_id``, ``place``, ``finding_sha256``, ``length``, ``label``, ``probability``, ``is_secret``.

    One row a candidate. Labelled findings are those of ``labelled`` (``finding_sha256``, ``label`` 0 or 1,
    as people have judged them; a digest judged both ways is none) and, where that says nothing, those
    that a rule decides. The forest learns from the labelled findings of documents for which
    ``learn_from`` holds. Secrets themselves are not returned, only their digests.
    """
    held = findings(documents, dictionary)
    label = rule_label()
    if labelled is not None:
        judged = labelled.where("label in (0, 1)").groupBy(F.col("finding_sha256").alias("_judged")).agg(
            F.min("label").cast("double").alias("_low"), F.max("label").cast("double").alias("_high")
        ).where("_low = _high")
        held = held.join(judged, F.sha2("candidate", 256) == F.col("_judged"), "left")
        label = F.coalesce("_low", label)
    held = held.withColumn("label", label)
    model = train(held.where(learn_from & F.col("label").isNotNull()))
    return judge(held, model).select(
        "doc_id",
        "place",
        F.sha2("candidate", 256).alias("finding_sha256"),
        F.col("length").cast("long").alias("length"),
        F.col("label").cast("int").alias("label"),
        "probability",
        (F.col("probability") >= limit).cast("int").alias("is_secret"),
    )
