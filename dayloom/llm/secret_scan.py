"""Secret scan with a random forest that removes false positives.

Everything runs as DataFrame expressions and Spark ML, without Python on executors.
Candidates are long unbroken runs of key characters, and values of any printable signs that
are assigned to a credential name or stand as the password of an address. The pieces of text between them give
each candidate's neighbours. Findings are labelled by their setting (assignments to
credential names, passwords of addresses) and by published key formats. The forest never
sees that setting: it learns from length, character transitions, dictionary coverage, path
and the other neighbouring words, the credential names and the signs of an assignment left
out. So it judges a value by what it is: words that are assigned to a credential name are
removed as false positives, and a key that stands alone is still found.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from dayloom.llm.common import saved

#: A candidate: so many key characters in a row, and nothing of the kind around them.
RUN = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}={0,2}(?![A-Za-z0-9_+/=-])"
#: Characters before and after a candidate that hold its neighbouring words.
NEAR = 48
#: Names whose assigned value is a credential, and keys of published formats.
NAMES = r"(?:token|passw(?:or)?d|pwd|secret|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer)"
CREDENTIAL = r"(?i)" + NAMES + r"[\"' ]{0,3}(?:[:=]|=>|\s)[\"' ]{0,3}$"
#: Also candidates: four printable signs or more that are assigned to such a name, up to the
#: closing quote or else to white space, without signs that end a clause; and passwords of addresses.
ASSIGNED = (
    r"(?<=[:=>\"' ])(?=[\x21\x23-\x26\x28-\x3c\x3f-\x7e][\x21-\x7e]{3})(?<=[:=>][\"' ]{0,3})"
    r"(?<=(?i:" + NAMES + r")[\"' ]{0,3}(?:=>|[:=])[\"' ]{0,3})"
    r"(?:(?<=\")[\x21\x23-\x7e]{4,}(?=\")|(?<=')[\x21-\x26\x28-\x7e]{4,}(?=')|[\x21\x23-\x26\x28-\x7e]{4,}(?<![,;.:)\]}]))"
)
IN_ADDRESS = (
    r"(?<=:)(?<=://[\x21\x23-\x26\x28-\x2e\x30-\x39\x3b-\x3f\x41-\x7e]{0,64}:)"
    r"[\x21\x23-\x26\x28-\x2e\x30-\x3f\x41-\x7e]{4,}(?=@)"
)
CANDIDATE = f"{IN_ADDRESS}|{ASSIGNED}|{RUN}"
#: What stands for a value that is filled in elsewhere.
FILLED_IN = r"^(?:\$\{?\(?[A-Za-z_].*|%[({].*|<.*>|\{.*\})$"
FORMATS = (
    r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}$|^xox[abprs]-[0-9A-Za-z-]{10,}$"
    r"|^(?:sk|rk|pk)_(?:live|test)_[0-9A-Za-z]{16,}$|^AIza[0-9A-Za-z_-]{35}$|^glpat-[0-9A-Za-z_-]{20}$"
)
DUMMY = r"(?i)example|dummy|sample|placeholder|change_?me|redacted|x{6,}|0{8,}|1234567890|abcdefgh"
#: What makes the label and is kept from the forest: the name before an assigned value and
#: the part of an address before its password.
SETTING = r"[\w.-]*[\"' ]{0,3}(?:[:=]|=>|\s)[\"' ]{0,3}$|\S+://\S*$"
CREDENTIAL_WORD = r"(?i)\b(?:token|passw(?:or)?d|pwd|secret|key|auth|credentials?|bearer|login)\b"
TEST_PATH = r"(?i)test|example|sample|mock|fixture|docs?/"
#: Bounds of the training sample by label, and of the dictionary: a word of it is in so
#: many texts at least.
SECRETS, OTHERS, WORD_TEXTS = 4000, 12000, 3
TREES, DEPTH, SEED = 30, 6, 7
#: Slots that neighbouring words are hashed into.
WORD_SLOTS = 24
VALUE_FEATURES = [
    "n", "transitions", "transition_rate", "digits", "uppers", "lowers", "others", "distinct_share", "hex", "vowels",
    "covered", "longest_run", "dummy", "digit_neighbour", "test_path",
]
FEATURES = [*VALUE_FEATURES, *(f"word{i}" for i in range(WORD_SLOTS))]


def candidates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source"
) -> DataFrame:
    """``(key, row, path, start, value, before, after)`` of every candidate of every text.

    ``start`` counts characters from 0. ``row`` is a hash of the text, so that repeated
    ids with different texts stay apart. Null and empty texts have no candidates; a null
    path is empty.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), where.alias("path"))
    rows = rows.select(
        "_key", F.xxhash64("_text").alias("row"), "path",
        F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)).alias("_values"), F.split("_text", CANDIDATE, -1).alias("_rest"),
    ).filter(F.size("_values") > 0)
    rows = rows.select("_key", "row", "path", F.posexplode("_values").alias("_i", "value"), "_values", "_rest")
    length = lambda part, upto: F.aggregate(
        F.slice(part, 1, upto), F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)
    )
    start = length(F.col("_rest"), F.col("_i") + 1) + length(F.col("_values"), F.col("_i"))
    return rows.select(
        F.col("_key").alias(key), "row", "path", start.alias("start"), "value",
        F.right(F.element_at("_rest", F.col("_i") + 1), F.lit(NEAR)).alias("before"),
        F.left(F.element_at("_rest", F.col("_i") + 2), F.lit(NEAR)).alias("after"),
    )


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lower-case words of three letters or more that at least ``WORD_TEXTS`` texts hold."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), r"[^a-z]+"))
    words = docs.select(F.explode(F.filter(words, lambda w: F.length(w).between(3, 24))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("_n")).filter(F.col("_n") >= WORD_TEXTS).select("word")


def _count(value: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{kind}]", ""))


def measured(found: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidates with their features.

    Dictionary coverage is the share of letters in runs that are known words. It is looked
    up once per distinct value, so a value that a third of all texts repeat is one row.
    """
    value = F.col("value")
    runs = F.split(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z]+")
    split_up = found.select("value").distinct().select("value", F.posexplode(runs).alias("_i", "_run"))
    split_up = split_up.filter(F.length("_run") >= 3).select("value", F.lower("_run").alias("word"), "_i")
    covered = (
        split_up.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("_covered"))
    )
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    n = F.length(value)
    flag = lambda c: c.cast("double")
    return (
        found.join(covered, "value", "left")
        .withColumn("n", n.cast("double"))
        .withColumn("transitions", (F.length(kinds) - 1).cast("double"))
        .withColumn("transition_rate", F.col("transitions") / n)
        .withColumn("digits", _count(value, "0-9") / n)
        .withColumn("uppers", _count(value, "A-Z") / n)
        .withColumn("lowers", _count(value, "a-z") / n)
        .withColumn("others", F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")) / n)
        .withColumn("distinct_share", F.size(F.array_distinct(F.split(value, ""))) / n)
        .withColumn("hex", flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")))
        .withColumn("vowels", _count(F.lower(value), "aeiou") / (_count(value, "A-Za-z") + 1))
        .withColumn("covered", F.coalesce(F.col("_covered"), F.lit(0)) / n)
        .withColumn("longest_run", F.array_max(F.transform(runs, lambda r: F.length(r))).cast("double"))
        .withColumn("in_address", flag(F.col("before").rlike("://[^\\s/:@\"']*:$") & F.col("after").startswith("@")))
        .withColumn("dummy", flag(value.rlike(DUMMY)))
        .withColumn("digit_neighbour", flag(F.col("before").rlike("[0-9+()]\\s*$") | F.col("after").rlike("^\\s*[0-9+()]")))
        .withColumn("test_path", flag(F.col("path").rlike(TEST_PATH)))
        .withColumn("_near", neighbours())
        .withColumns({f"word{i}": flag(F.array_contains("_near", i)) for i in range(WORD_SLOTS)})
        .drop("_covered", "_near")
    )


def neighbours() -> Column:
    """Slots of the words around a candidate, cut words at the window's edge and all words
    of the label's setting left out."""
    before = F.regexp_replace(F.regexp_replace("before", r"^\S*", ""), SETTING, " ")
    words = F.split(F.lower(F.concat_ws(" ", before, F.regexp_replace("after", r"\S*$", ""))), r"[^\p{L}]+")
    words = F.filter(words, lambda w: F.length(w).between(2, 24) & ~w.rlike(CREDENTIAL_WORD))
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(WORD_SLOTS)).cast("int")))


def labelled(findings: DataFrame) -> DataFrame:
    """``findings`` with ``label``: 1 for values of published key formats, passwords of
    addresses, and values with a digit (short ones with a letter too) that are assigned to a
    credential name, unless they are dummies or filled in elsewhere; 0 for all others."""
    value = F.col("value")
    like = value.rlike("[0-9]") & ((F.col("n") >= 16) | value.rlike("[A-Za-z]"))
    secret = (F.col("before").rlike(CREDENTIAL) & like) | (F.col("in_address") > 0) | value.rlike(FORMATS)
    return findings.withColumn("label", (secret & (F.col("dummy") == 0) & ~value.rlike(FILLED_IN)).cast("double"))


def train(findings: DataFrame) -> PipelineModel | None:
    """A forest from a bounded sample of labelled findings, drawn by md5 of their values;
    None if they don't hold both labels."""
    rows = findings.withColumn("_order", F.md5("value"))
    parts = [
        rows.filter(F.col("label") == x).orderBy("_order", "value", "before", "after").limit(n)
        for x, n in ((1.0, SECRETS), (0.0, OTHERS))
    ]
    sample = saved(parts[0].unionByName(parts[1]).select(*FEATURES, "label").coalesce(1), "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features"
    ).fit(gather.transform(sample))
    return PipelineModel([gather, forest])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """Every candidate of every text with the forest's verdict:
    ``(key, row, start, n, value, chance, secret)``.

    Texts that are null or empty have no rows; repeated rows have theirs repeated. If the
    findings hold only one label, that label is the verdict for all.
    """
    found = saved(candidates(docs, key, text, path), "candidates")
    found = labelled(saved(measured(found, dictionary(docs, text), key), "findings"))
    model = train(found)
    if model is None:
        judged = found.withColumn("chance", F.col("label"))
    else:
        judged = model.transform(found).withColumn("chance", vector_to_array("probability")[1])
    return judged.select(
        key, "row", "start", F.col("n").cast("int").alias("n"), "value", "chance", (F.col("chance") >= 0.5).alias("secret")
    )


def redact(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", length: str = "n_chars",
    mark: str = "[SECRET]",
) -> DataFrame:
    """``docs`` with every confirmed secret replaced by ``mark``; same rows and columns.

    Only texts with secrets change, and so does their ``length`` column if there is one.
    Their values are gathered per text (a handful of runs that the text itself holds) and
    replaced between its other pieces. Null and empty texts and null keys stay as they
    are, repeated rows are masked each, an empty table stays empty, and further columns
    may have any name.
    """
    verdict = scan(docs, key, text, path).filter("secret")
    values = verdict.groupBy(F.col("row").alias("_row")).agg(F.collect_set("value").alias("_secrets"))
    found = F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0))
    pieces = F.split("_text", CANDIDATE, -1)
    shown = F.transform(found, lambda v: F.when(F.array_contains("_secrets", v), F.lit(mark)).otherwise(v))
    joined = F.array_join(F.flatten(F.transform(
        F.arrays_zip(pieces.alias("p"), F.concat(shown, F.array(F.lit(""))).alias("v")),
        lambda z: F.array(z["p"], z["v"]),
    )), "")
    # only texts with secrets meet their values; the table's columns travel in a struct, so
    # that none can clash with a helper
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text"), F.xxhash64(text).alias("_row"))
    some = F.coalesce(F.col("_text").rlike(CANDIDATE), F.lit(False))
    masked = packed.filter(some).join(values, "_row", "left").withColumn("_masked", F.when(F.col("_secrets").isNotNull(), joined))
    counted = F.length("_masked").cast(dict(docs.dtypes).get(length, "int"))
    changed = {text: F.col("_masked"), length: counted}
    own = lambda c: F.col("_doc").getField(c)
    masked = masked.select(*[
        F.when(F.col("_masked").isNotNull(), changed[c]).otherwise(own(c)).alias(c) if c in changed else own(c).alias(c)
        for c in docs.columns
    ])
    return masked.union(packed.filter(~some).select("_doc.*"))
