"""Operator 4: secret scan with a random forest against false findings.

Candidates are long strings with digits or mixed case. The forest judges length,
character transitions, dictionary coverage, path and neighbouring words. It is fitted
on labelled findings; without given ones, on those that rules of public formats settle.
DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_sample, fold_of, prepare, settle

#: A candidate within a word of the text, and what it must hold.
VALUE = r"[A-Za-z0-9_+/\-]{16,}={0,2}"
_LOOKS = r"(?=[^0-9]*[0-9])|[a-z][A-Z][a-z]*[A-Z]"
#: Public formats of access keys.
FORMATS = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abpr]-[A-Za-z0-9\-]{10,}$|^sk_live_[A-Za-z0-9]{16,}$"
#: Words that announce a secret, and words that announce a made-up one.
NAMES = r"(?i)(passw(or)?d|secret|token|api_?key|access_?key|credential|auth|bearer|private)"
MADE_UP = r"(?i)(example|sample|dummy|placeholder|changeme|your_|xxxx|test|fake|mock)"
#: Common words of identifiers; the part of a candidate that they cover speaks against it.
DICTIONARY = (
    "account address class client config connection content context control count create "
    "data default description document element error event example file filter function "
    "group handler header height image index input item label length level list manager "
    "message method model module name number object option output package page parameter "
    "path position process property request response result server service session size "
    "source state status string style system table target template test text time title "
    "type update user value version view width window with from that this have which"
).split()
#: Labelled findings of a kind that the forest is fitted on; trees and their depth.
SAMPLE, TREES, DEPTH = 5000, 20, 6
THRESHOLD = 0.5

FEATURES = (
    "length", "transitions", "digits", "capitals", "distinct", "coverage", "named", "assigned",
    "made_up", "test_path", "in_path", "in_address",
)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, place, value, path, before, word, after) of each candidate.

    place counts the words of the text from 0. Texts without a candidate are left
    before their words are looked at; no row is made for other words.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.select("doc_id", F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), text.alias("text")).filter(
        F.col("text").rlike(VALUE)
    ).withColumn("words", F.split("text", r"[\x20\x09-\x0D]+"))
    found = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("word"))),
        lambda x: (F.length(x["word"]) >= 16) & x["word"].rlike(VALUE) & x["word"].rlike(_LOOKS),
    )
    rows = words.withColumn("x", F.explode(found))
    near = lambda by: F.coalesce(F.try_element_at("words", F.when(F.col("x.place") + by >= 0, F.col("x.place") + by + 1).cast("int")), F.lit(""))
    rows = rows.select(
        "doc_id", "path", F.col("x.place").alias("place"), F.col("x.word").alias("word"),
        F.concat_ws(" ", near(-3), near(-2), near(-1)).alias("before"), near(1).alias("after"),
    )
    values = rows.withColumn("value", F.explode(F.regexp_extract_all("word", F.lit(f"({VALUE})"), 1)))
    return values.filter(F.col("value").rlike(_LOOKS))


def described(found: DataFrame) -> DataFrame:
    """Candidates with the features of the forest, all doubles."""
    value, lower = F.col("value"), F.lower("value")
    size = F.length(value)
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    known = F.length(F.regexp_replace(lower, "(" + "|".join(sorted(DICTIONARY)) + ")", ""))
    around = F.concat_ws(" ", "before", "word")
    yes = lambda x: x.cast("double")
    columns = {
        "length": size.cast("double"),
        "transitions": count("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"),
        "digits": count("[0-9]"),
        "capitals": count("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "coverage": 1 - known / size,
        "named": yes(around.rlike(NAMES)),
        "assigned": yes(around.rlike(r"[:=]\s*[\"']?$|[:=][\"']?[A-Za-z0-9_+/\-]{16,}|[:=]\s+[\"']")),
        "made_up": yes(F.concat_ws(" ", around, "after").rlike(MADE_UP)),
        "test_path": yes(F.col("path").rlike(r"(?i)(test|example|sample|fixture|doc)")),
        "in_path": yes(F.col("word").rlike(r"[/\\][^/\\]+[/\\]|\.[a-z]{2,4}$")),
        "in_address": yes(F.col("word").rlike(r"@|://")),
    }
    return found.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in columns.items()})


def rule_labels(found: DataFrame) -> DataFrame:
    """Findings that rules settle: label 1 for a public format or a value assigned to a
    telling name, 0 for plain numbers, addresses, paths and made-up values."""
    secret = F.col("value").rlike(FORMATS) | (
        (F.col("named") == 1) & (F.col("assigned") == 1) & F.col("value").rlike(r"[0-9]") & F.col("value").rlike("[A-Za-z]")
    )
    plain = F.col("value").rlike(r"^[0-9\-]+$") | (F.col("in_address") == 1) | (F.col("in_path") == 1) | (F.col("coverage") > 0.5)
    label = F.when(F.col("made_up") == 1, 0).when(secret, 1).when(plain, 0)
    return found.withColumn("label", label).filter("label IS NOT NULL")


def _kind(value: Column, named: Column) -> Column:
    return F.when(value.rlike(FORMATS), "format").when(named == 1, "named").otherwise("other")


def secret_scan(docs: DataFrame, findings: DataFrame | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD, path: str = "source") -> DataFrame:
    """doc_id, place, kind, value_length, value_sha256, score and kept of each candidate.

    ``findings`` (doc_id, value, label 0 or 1) trains the forest; None: findings of rows
    whose crc32 of the id modulo 3 is not 1, labelled by rules. At most ``sample`` of
    each label are used, by a hash of the value. score is the forest's share for a
    secret; those below ``threshold`` are false findings and not kept. Without findings
    of both labels nothing can be judged: every score is 1 and all are kept. Texts that
    are null or empty have no candidates, a null path counts as empty; repeated rows are
    scanned each for itself; an empty table gives no rows; further columns are not read.
    """
    prepare(docs.sparkSession)
    found = settle(described(candidates(docs, path)))
    if findings is None:
        labelled = rule_labels(found.filter(fold_of(F.col("doc_id"), 3) != 1))
    else:
        labelled = found.join(findings.select("doc_id", "value", "label").distinct(), ["doc_id", "value"]).filter(F.col("label").isin(0, 1))
    learnt = settle(bounded_sample(labelled.select("value", "label", *FEATURES).distinct(), "label", sample, "value", *FEATURES))
    result = lambda rows, score: rows.withColumn("score", score).select(
        "doc_id", "place", _kind(F.col("value"), F.col("named")).alias("kind"), F.length("value").alias("value_length"),
        F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= threshold).alias("kept"),
    )
    if learnt.select("label").distinct().count() < 2:
        return result(found, F.lit(1.0))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=17, labelCol="label", featuresCol="features")
    model = forest.fit(assembler.transform(learnt.withColumn("label", F.col("label").cast("double"))))
    return result(model.transform(assembler.transform(found)), vector_to_array("probability")[1])
