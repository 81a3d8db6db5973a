"""Secret scans: a random forest removes false findings, with built-in functions alone.

Candidates are long runs of key characters. Each becomes numbers: its length, its characters and
the transitions between their classes, how much of it dictionary words cover, the path (source)
it comes from and the words beside it. The forest is trained on labelled findings, which
``labelled_findings`` makes by rule: keys, tokens and passwords as they stand in code and logs,
and the look-alikes that scanners report wrongly (hashes of commits, ids, numbers, long words,
place-holders, file paths).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.spans import SPAN, spans

CONTEXT, THRESHOLD, FINDINGS = 40, 0.5, 4_000
TREES, DEPTH = 24, 7
# Runs of key characters, of 16 or more, that hold a digit or change from lower to upper case. A sign of
# equality before a run assigns it, and one after it is padding only where no value follows.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,200}[0-9]|[A-Z+/_-]*[a-z]{1,200}[A-Z])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![\"'`]?[A-Za-z0-9+/_=-]))?"
HINT = r"[A-Za-z0-9+/_-]{16}"
WORDS = "the and for with this that from have not are was will can all one time test name user data file path code value type list item page home main index image media static content config default system public private example sample dummy your insert here change replace commit hash version build release string number object class method return import package module service server client request response".split()
KEYWORDS = r"(?i)(passw|pwd|token|secret|api|auth|bearer|credential|access|private|key)"
LOOKALIKES = r"(?i)(commit|sha1|sha256|md5|checksum|digest|uuid|guid|request|order|number|file|path|image|example|placeholder|revision)"
FEATURES = ["length", "digits", "upper", "lower", "marks", "hex", "only_hex", "only_digits", "distinct", "changes", "vowels", "words", "assigned", "quoted", "keyword", "lookalike", "prefix", "test_path", "code_path"]


def _share(value: Column, pattern: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / F.length(value)


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """The columns ``FEATURES`` of a candidate."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    path = F.lower(F.coalesce(path, F.lit("")))
    changes = F.length(F.regexp_replace(F.regexp_replace(value, r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])", " "), "[^ ]", "")) / F.length(value)
    dictionary = "(" + "|".join(sorted(WORDS, key=lambda w: (-len(w), w))) + ")"
    return [c.cast("double").alias(n) for n, c in zip(FEATURES, [
        F.least(F.length(value), F.lit(200)), _share(value, "[0-9]"), _share(value, "[A-Z]"), _share(value, "[a-z]"), _share(value, "[^A-Za-z0-9]"), _share(value, "[0-9a-fA-F]"),
        flag(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$")), flag(value.rlike("^[0-9]+$")), F.size(F.array_distinct(F.split(value, ""))) / F.least(F.length(value), F.lit(64)), changes, _share(value, "[aeiouAEIOU]"),
        _share(F.lower(value), dictionary), flag(before.rlike(r"[=:]\s*[\"']?$")), flag(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")), flag(before.rlike(KEYWORDS + r"[\w\"' ]{0,12}[=:]?\s*[\"']?$")), flag(before.rlike(LOOKALIKES + r"\W{0,6}$")),
        flag(value.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$|^(ghp|gho|xoxb|sk|pk|rk)[_-]|^eyJ|^glpat-")), flag(path.rlike("test|spec|mock|fixture|sample|example")), flag(path.rlike(r"\.(py|js|ts|go|java|rb|sh|env|ya?ml|json|ini|cfg|toml)$")),
    ], strict=True)]


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """``n`` findings by rule: value, before, after, path, label (1: a secret)."""
    hx = lambda salt, k: F.left(F.sha2(F.concat_ws("/", F.lit(salt), "id"), 512), F.lit(k))
    b64 = lambda salt, k: F.left(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat_ws("/", F.lit(salt), "id"), 512))), r"[\r\n=]", ""), F.lit(k))
    up = lambda salt, k: F.left(F.regexp_replace(F.upper(b64(salt, 80)), "[^A-Z2-7]", ""), F.lit(k))
    pick = lambda salt, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(xs))) + 1).cast("int"))
    word = lambda salt: pick(salt, WORDS)
    some = ["", "and then ", "the log says ", "in the end ", "of it ", "see "]
    names = ["password", "passwd", "token", "secret", "api_key", "apikey", "auth_token", "access_key", "client_secret", "private_key"]
    assign = F.concat(pick("s", some), pick("n", names), pick("a", ["=", " = ", ": ", ":", '="', ' = "', ': "', "='"]))
    close = F.when(F.substring(assign, -1, 1).isin('"', "'"), F.substring(assign, -1, 1)).otherwise(" ")
    plain = F.concat(pick("s", some), pick("q", ["with ", "on ", "that ", "for ", "to ", ""]))
    size = F.lit(16) + F.pmod(F.xxhash64(F.lit("k"), "id"), F.lit(25)).cast("int")
    rows = [
        (F.concat(F.lit("AKIA"), up("u", 16)), plain, F.lit(" and"), 1),
        (hx("t", 40), assign, close, 1), (F.substring(hx("p", 60), F.lit(1), size), assign, close, 1), (b64("b", 40), assign, close, 1),
        (F.concat(F.lit("ghp_"), F.regexp_replace(b64("g", 40), "[+/]", "x")), plain, F.lit(" "), 1),
        (F.concat(pick("pre", ["sk_live_", "xoxb-", "glpat-"]), F.regexp_replace(b64("x", 28), "[+/]", "Q")), assign, close, 1),
        (hx("c", 40), F.concat(plain, pick("cw", ["commit ", "sha1 ", "revision ", "commit: ", "checksum "])), F.lit(" "), 0),
        (hx("m", 64), F.concat(plain, pick("mw", ["sha256:", "digest ", "md5 ", "checksum="])), F.lit(" "), 0),
        (F.concat_ws("-", hx("d1", 8), hx("d2", 4), hx("d3", 4), hx("d4", 4), hx("d5", 12)), F.concat(plain, pick("dw", ["uuid ", "request ", "id=", "guid: "])), F.lit(" "), 0),
        (F.left(F.regexp_replace(F.sha2(F.concat(F.lit("z"), "id"), 512), "[a-f]", ""), F.lit(17)), F.concat(plain, pick("zw", ["number ", "order ", "", "call "])), F.lit(" "), 0),
        (F.concat_ws("_", word("1"), word("2"), word("3"), word("4")), assign, close, 0), (F.concat(word("5"), F.initcap(word("6")), F.initcap(word("7")), F.initcap(word("8"))), plain, F.lit(" "), 0),
        (F.concat(F.repeat(pick("r", ["x", "X", "0", "1", "ab", "12"]), 20)), assign, close, 0), (F.concat_ws("/", word("9"), word("10"), F.concat(word("11"), F.left(hx("f", 2), F.lit(2)))), F.concat(plain, F.lit("path ")), F.lit(" "), 0),
        (F.concat(word("12"), F.lit("-"), word("13"), F.lit("-"), F.pmod(F.col("id"), F.lit(2030)).cast("string"), F.lit("-"), word("14")), plain, F.lit(" "), 0),
    ]
    ids = spark.range(0, n, 1, 1)
    kind = F.pmod(F.col("id"), F.lit(len(rows)))
    cases = F.array(*(F.struct(v.alias("value"), b.alias("before"), a.alias("after"), F.lit(y).alias("label")) for v, b, a, y in rows))
    return ids.select(F.element_at(cases, (kind + 1).cast("int")).alias("c"), pick("path", ["src0", "src7", "app/main.py", "conf/prod.env", "docs/readme", "tests/unit.py", "web/config.json"]).alias("path")).select("c.*", "path")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """A forest on labelled findings (value, before, after, path, label)."""
    rows = findings.select(*features(F.col("value"), F.col("before"), F.col("after"), F.col("path")), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt").fit(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows).select(F.col("x").alias("features"), "label"))


def candidates(docs: DataFrame) -> DataFrame:
    """A row per candidate: doc_id, h (the text's hash), start, end, value, before, after, path."""
    text = F.when(F.col("text").rlike(HINT), spans(F.col("text"), CANDIDATE, CONTEXT, whole=True)).otherwise(F.array().cast(SPAN))
    path = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    found = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), path.cast("string").alias("path"), F.explode(text).alias("s"))
    return found.select("doc_id", "h", "s.start", "s.end", "s.value", "s.before", "s.after", "path")


def findings(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``candidates`` with ``score`` and ``secret`` (score >= threshold)."""
    model = model or train(labelled_findings(docs.sparkSession))
    rows = candidates(docs)
    rows = rows.select("*", *features(F.col("value"), F.col("before"), F.col("after"), F.col("path")))
    scored = model.setFeaturesCol("x").transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", "h", "start", "end", "value", "before", "after", "path", score.alias("score"), (score >= threshold).alias("secret"))


def secret_report(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_candidates, n_secrets, spans (``start:end`` in code points, by start, comma-joined).

    Null and empty texts have none. Rows that agree in doc_id and text share their findings, which
    count once; their path is the smallest of theirs.
    """
    found = findings(docs, model, threshold).groupBy("doc_id", "h", "start", "end").agg(F.min_by("secret", F.coalesce("path", F.lit(""))).alias("secret"))
    own = found.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("secret").alias("n_secrets"), F.sort_array(F.collect_list(F.when(F.col("secret"), F.struct("start", "end")))).alias("s"))
    own = own.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "n_candidates", "n_secrets", "s")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"))
    joined = rows.join(own, rows["doc_id"].eqNullSafe(own["_id"]) & (rows["h"] == own["_h"]), "left")
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return joined.select("doc_id", F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"), F.coalesce("n_secrets", F.lit(0)).cast("long").alias("n_secrets"), F.coalesce(text, F.lit("")).alias("spans"))


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each secret replaced by ``[SECRET]``; other columns as they were, ``n_chars`` follows.

    Null texts stay null, repeated rows are treated alike and an empty table gives none.
    """
    found = findings(docs, model, threshold).where("secret").select("doc_id", "h", "start", "end").distinct()
    own = found.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    own = own.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "_cuts")
    joined = docs.join(own, docs["doc_id"].eqNullSafe(own["_id"]) & (F.xxhash64(docs["text"]) == own["_h"]), "left")
    zero = F.struct(F.lit(0).alias("at"), docs["text"].alias("t"), F.lit("").alias("out"))
    step = lambda a, c: F.struct(c["end"].alias("at"), a["t"].alias("t"), F.concat(a["out"], a["t"].substr(a["at"] + 1, c["start"] - a["at"]), F.lit("[SECRET]")).alias("out"))
    new = F.when(own["_cuts"].isNull(), docs["text"]).otherwise(F.aggregate(own["_cuts"], zero, step, lambda a: F.concat(a["out"], a["t"].substr(a["at"] + 1, F.length(a["t"])))))
    out = joined.select(*(new.alias("text") if c == "text" else docs[c] for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
