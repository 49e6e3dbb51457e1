"""Secret scan: candidates by pattern, false positives removed by a random forest, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import broadcast_up_to, cut

#: A run of at least 12 characters of keys and tokens with a digit among them.
CANDIDATE = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{12,}={0,2}"
#: At most so many labelled findings are fitted on.
SAMPLE_ROWS = 10_000
TREES, DEPTH, SEED = 20, 6, 11
THRESHOLD = 0.5
_KEYWORD = r"(?i)(pass(word|wd)?|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
#: A word of the dictionary stands by itself in so many documents; shorter runs of letters are no words.
DICTIONARY_DOCS, WORD_LETTERS = 3, 4
#: Words that may be broadcast to the documents (tens of bytes each); more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Pieces of a text whose lengths are summed one by one; sums of such runs are summed in turn.
RUN = 512
#: A word within a candidate: letters of one kind, or with a capital at the front.
_WORD = "[A-Z]?[a-z]{3,}|[A-Z]{4,}"
_ALONE = r"(?<![\p{L}\p{N}_+/=-])\p{L}{4,}(?![\p{L}\p{N}_+/=-])"
FEATURES = ("length", "digits", "upper", "lower", "turns", "distinct", "covered", "hexadecimal", "path", "dots", "keyword", "assigned", "quoted", "numbers_near")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, value, before, after): each candidate with the text of up to 40 characters on either side; start counts code points.

    Null and empty texts have none; very long ones are read whole, in time linear in their candidates; a row
    without an id is scanned like any other; repeated rows repeat; other columns are not looked at.
    """
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select(
        "id", "text", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values")).filter(F.size("values") > 0)
    # The pieces between the matches give their places: piece, match, piece, ..., piece.
    parts = found.select("id", "values", F.split("text", CANDIDATE, -1).alias("between")).withColumn(
        "runs", F.transform(F.sequence(F.lit(0), F.floor((F.size("values") - 1) / RUN).cast("int")), lambda k: F.zip_with(
            F.slice("between", k * RUN + 1, RUN), F.slice("values", k * RUN + 1, RUN), lambda b, v: F.struct(F.length(b).alias("b"), F.coalesce(F.length(v), F.lit(0)).alias("v")))))
    return parts.select("id", F.explode(F.arrays_zip(
        _places().alias("start"), F.col("values").alias("value"), F.transform("between", lambda b: F.right(b, F.lit(40))).alias("before"),
        F.transform(F.slice("between", 2, F.size("values")), lambda b: F.left(b, F.lit(40))).alias("after"))).alias("c")).select(
            "id", "c.start", "c.value", "c.before", "c.after").filter("value is not null")


def _places() -> Column:
    """Where each match starts: the lengths of the pieces and matches before it, summed within runs and over runs."""
    def sums(steps: Column, step, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(steps, start, step, lambda acc: acc["out"])

    whole = lambda run: F.aggregate(run, F.lit(0), lambda n, s: n + s["b"] + s["v"])
    begins = sums(F.transform("runs", whole), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), F.lit(0))
    within = lambda run, begin: sums(run, lambda acc, s: F.struct((acc["at"] + s["b"] + s["v"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + s["b"])).alias("out")), begin)
    return F.flatten(F.zip_with("runs", begins, within))


def dictionary(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(word): of the words within candidates those that stand by themselves in DICTIONARY_DOCS documents or more, in lower case.

    All documents are counted, but only for words that some candidate has, so that no list is cut off.
    """
    asked = broadcast_up_to(cut(found.select(F.explode(F.array_distinct(_words_of(F.col("value")))).alias("word")).distinct()), BROADCAST_ROWS)
    alone = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(_ALONE), F.lit(0)))).alias("word"))
    return alone.join(asked, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= DICTIONARY_DOCS).select("word")


def _words_of(value: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(value, F.lit(_WORD), F.lit(0)), F.lower), lambda w: F.length(w) >= WORD_LETTERS)


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with known: how many of a value's characters lie in words of the dictionary."""
    values = found.select("value").distinct()
    each = values.select("value", F.explode(_words_of(F.col("value"))).alias("word")).join(words, "word")
    known = each.groupBy("value").agg(F.sum(F.length("word")).alias("known"))
    return found.join(known, "value", "left").withColumn("known", F.coalesce("known", F.lit(0)))


def featured(found: DataFrame) -> DataFrame:
    """found (with known, from covered()) with FEATURES: length, shares and changes of character kinds, dictionary cover, path and neighbouring words."""
    v, n = F.col("value"), F.length("value").cast("double")
    count = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    near = F.concat_ws(" ", F.right("before", F.lit(40)), F.left("after", F.lit(40)))
    made = {
        "length": n, "digits": count("[0-9]") / n, "upper": count("[A-Z]") / n, "lower": count("[a-z]") / n,
        "turns": count("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])") / n,
        "distinct": F.size(F.array_distinct(F.split(F.lower(v), ""))) / n,
        "covered": F.col("known") / n,
        "hexadecimal": v.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"), "path": count("/"),
        "dots": (F.col("before").rlike(r"[@./:]$") | F.col("after").rlike(r"^[@./]")).cast("double"),
        "keyword": (F.col("before").rlike(_KEYWORD + r"\W{0,6}$")).cast("double"),
        "assigned": F.col("before").rlike(r"[=:]\s?[\"']?$").cast("double"), "quoted": F.col("before").rlike(r"[\"']$").cast("double"),
        "numbers_near": F.regexp_count(near, F.lit("[0-9]")).cast("double"),
    }
    return found.withColumns(made)


def rule_label(found: DataFrame) -> DataFrame:
    """found with label, for corpora without reviewed findings: 1 and 0 where a finding is plain, null where it is not.

    Plain secrets are published key formats and quoted or assigned credentials. Plain false alarms, which look
    like them, are numbers, dates, identifiers in UUID form, digests that the words before them name, and values
    that are mostly path or words. The forest learns from the plain ones, and decides on all.
    """
    v = F.col("value")
    known = v.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk_live_[A-Za-z0-9]{16,}$|^xox[abp]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_-]{35}$")
    told = F.col("before").rlike(_KEYWORD + r"\s?[=:]\s?[\"']?$") & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    number = v.rlike("^[0-9_+/-]+$") | v.rlike("^[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-]?[0-9]*Z?$")
    uuid = v.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    digest = v.rlike("^[0-9a-f]{32,64}$") & F.col("before").rlike(r"(?i)(commit|revision|sha-?1|sha-?256|md5|checksum|digest|hash|etag)\W{0,3}$")
    worded = (2 * F.col("known") >= F.length("value")) | (F.regexp_count(v, F.lit("/")) >= 2)
    return found.withColumn("label", F.when(known | told, 1.0).when(number | uuid | digest | worded, 0.0))


def reviewed_label(found: DataFrame, reviewed: DataFrame) -> DataFrame:
    """found with the labels of reviewed findings (value_sha256, label); where a value has none, rule_label's."""
    own = reviewed.groupBy(F.col("value_sha256").alias("_sha")).agg(F.max(F.col("label").cast("double")).alias("_told"))
    joined = rule_label(found).withColumn("_sha", F.sha2("value", 256)).join(own, "_sha", "left")
    return joined.withColumn("label", F.coalesce("_told", "label")).drop("_sha", "_told")


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(found)


def _drawn(findings: DataFrame, rows: int) -> DataFrame:
    """Up to `rows` findings, those with the least hashes; of many, about twice as many are taken by the hash first."""
    total, order = findings.count(), F.pmod(F.xxhash64("value", "before", "after"), F.lit(1 << 40))
    if total > 4 * rows:
        findings = findings.filter(order < int((1 << 40) * 2 * rows / total))
    return findings.orderBy(order, "value", "before", "after").limit(rows).select("label", *FEATURES)


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RandomForestClassificationModel | None:
    """A forest from featured findings with a label; None if they are not of both kinds.

    Half of the sample is for each label, over distinct findings: rare secrets and large groups of copies leave it whole.
    """
    distinct = cut(labelled.filter("label is not null").dropDuplicates(["value", "before", "after", "label"]))
    yes, no = (cut(_drawn(distinct.filter(F.col("label") == k), sample_rows // 2)) for k in (1, 0))
    if not yes.limit(1).count() or not no.limit(1).count():
        return None
    return RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(_vectors(yes.unionByName(no)))


def scan(docs: DataFrame, model: RandomForestClassificationModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
         found: DataFrame | None = None) -> DataFrame:
    """(id, start, value, score) of the candidates that the forest takes for secrets; without a forest, of those that rule_label does."""
    if found is None:
        found = findings(docs, id_col, text_col)
    if model is None:
        return rule_label(found).filter("label = 1").select("id", "start", "value", F.lit(1.0).alias("score"))
    scored = model.setFeaturesCol("_features").transform(_vectors(found))
    return scored.select("id", "start", "value", vector_to_array("probability")[1].alias("score")).filter(F.col("score") >= threshold)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All candidates of docs with FEATURES, computed once."""
    raw = cut(candidates(docs, id_col, text_col))
    return cut(featured(covered(raw, dictionary(docs, raw, text_col))))


def op6_secrets(docs: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """A row for each secret: doc_id, start, length, value_sha256, score. The values themselves stay out of the result.

    reviewed findings (value_sha256, label), where there are some, go before the labels of plain cases. Null and
    empty texts have no secret; very long ones are read whole; a row without an id has its secrets under a null
    doc_id; repeated rows repeat them; equal candidates have equal scores; an empty table gives an empty result;
    other columns are not looked at.
    """
    found = findings(docs)
    model = train(rule_label(found) if reviewed is None else reviewed_label(found, reviewed))
    return scan(docs, model, found=found).select(F.col("id").alias("doc_id"), "start", F.length("value").alias("length"),
                                                 F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"))
