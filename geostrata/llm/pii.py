"""PII: information-theoretic sanitisation, with built-in functions alone.

Personal data of four kinds are found by patterns. Then the corpus tells which other terms give
them away: for a term t near an entity e, document frequencies over all documents estimate the
pointwise mutual information log2(N n(t,e) / (n(t) n(e))), that is, how many of the log2(N / n(e))
bits that identify e the term reveals. A term that reveals at least ``disclose`` of them, with
``support`` documents behind the estimate, is generalised near that entity; from ``remove`` on it
is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.llm.spans import SPAN, luhn, spans
from geostrata.runtime import checkpoint

KINDS = ("email", "ip", "card", "phone")
#: Code points on each side of an entity whose words count as near it.
CONTEXT = 80
SUPPORT, DISCLOSE, REMOVE = 3, 0.8, 0.95

# The patterns of the kinds. Possessive repeats match the same and cannot run out of stack. A match that
# starts inside a run of its first class can only begin there right after the match before (\G). Runs of fewer
# digits than a card has are no cards and are passed over at once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap test that holds for every text with a match.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda x: F.ltrim(x, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) < 3) | ((F.length(part(x)) == 3) & (part(x) <= "255")))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def entities(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, h (the text's hash) and an array of spans for each of ``KINDS``. Null reads as empty."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))

    def of(kind: str) -> Column:
        good = F.filter(spans(F.col("text"), PATTERNS[kind], CONTEXT + 1, whole=True), lambda s: _valid(kind, s["value"]))
        return F.when(F.col("text").rlike(HINTS[kind]), good).otherwise(F.array().cast(SPAN)).alias(kind)

    return own.select("doc_id", "h", *map(of, KINDS))


def _near(found: DataFrame) -> DataFrame:
    """Words near each entity: doc_id, h, entity, term, start, end (of the term)."""

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda s: s.withField("kind", F.lit(kind)))

    each = found.select("doc_id", "h", F.explode(F.concat(*map(tagged, KINDS))).alias("s"))
    entity = F.concat_ws(":", "s.kind", F.when(F.col("s.kind").isin("card", "phone"), F.regexp_replace("s.value", "[^0-9]", "")).otherwise(F.lower("s.value")))
    each = each.select("doc_id", "h", entity.alias("entity"), "s")
    before, after = F.col("s.before"), F.col("s.after")
    # a word that the edge cuts is left out: no boundary stands next to it
    left = F.when(F.length(before) > CONTEXT, before).otherwise(F.concat(F.lit(" "), before))
    right = F.when(F.length(after) > CONTEXT, after).otherwise(F.concat(after, F.lit(" ")))
    sides = each.select("doc_id", "h", "entity", F.explode(F.array(
        F.struct((F.col("s.start") - F.length(left)).alias("base"), spans(left, r"(?<=\P{L})\p{L}{3,}+", 0).alias("w")),
        F.struct(F.col("s.end").alias("base"), spans(right, r"\p{L}{3,}+(?=\P{L})", 0).alias("w")),
    )).alias("side"))
    words = sides.select("doc_id", "h", "entity", "side.base", F.explode("side.w").alias("w"))
    return words.select("doc_id", "h", "entity", F.lower("w.value").alias("term"), (F.col("base") + F.col("w.start")).alias("start"), (F.col("base") + F.col("w.end")).alias("end"))


def disclosing_terms(docs: DataFrame, near: DataFrame, support: int = SUPPORT, disclose: float = DISCLOSE) -> DataFrame:
    """(entity, term, revealed): terms that reveal at least the share ``disclose`` of what identifies the entity."""
    row = ["doc_id", "h"]
    both = near.select(*row, "entity", "term").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= support)
    each = near.select(*row, "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support)
    texts = docs.where("text is not null").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}+"), F.lit(0)))).alias("term"))
    terms = texts.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).where(F.col("n_term") >= support)
    total = docs.select(F.count(F.lit(1)).alias("n_docs"))
    known = both.join(each, "entity").join(terms, "term").crossJoin(F.broadcast(total))  # one row
    bits = F.log2(F.col("n_docs") / F.col("n_entity"))
    shared = F.log2(F.col("n_docs") * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    return known.withColumn("revealed", F.when(bits > 0, shared / bits).otherwise(0.0)).where(F.col("revealed") >= disclose).select("entity", "term", "revealed")


def _spans(docs: DataFrame, support: int, disclose: float) -> DataFrame:
    """``entities`` with ``terms``: sorted array of (start, end, revealed)."""
    found = checkpoint(entities(docs))
    near = checkpoint(_near(found.where(" or ".join(f"size({k}) > 0" for k in KINDS))))
    revealing = disclosing_terms(docs, near, support, disclose)
    hits = near.join(revealing, ["entity", "term"]).groupBy("doc_id", "h", "start", "end").agg(F.max("revealed").alias("revealed"))
    own = hits.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end", "revealed"))).alias("terms"))
    o = own.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "terms")
    joined = found.join(o, found["doc_id"].eqNullSafe(o["_id"]) & (found["h"] == o["_h"]), "left")
    return joined.select("doc_id", "h", *KINDS, F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,revealed:double>>")).alias("terms"))


def _named(kind: str, col: str | None = None) -> Column:
    return F.transform(col or kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def pii_report(docs: DataFrame, support: int = SUPPORT, disclose: float = DISCLOSE) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans.

    Null texts are empty. Rows that agree in doc_id and text count once in each document frequency
    of an entity, and all of them get the same spans.
    """
    s = _spans(docs, support, disclose)
    base = F.array_join(F.concat(*(_named(k) for k in KINDS)), ",")
    every = F.array_join(F.concat(*(_named(k) for k in KINDS), _named("term", "terms")), ",")
    return s.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.size("terms").cast("long").alias("n_term"), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def sanitise(docs: DataFrame, support: int = SUPPORT, disclose: float = DISCLOSE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with entities and disclosing terms generalised to their kind's name in brackets.

    Terms that reveal ``remove`` or more are removed instead. Of overlapping spans the first
    holds, and of an entity and a term that start together the entity. ``n_chars``, where the table
    has it, follows. Null texts stay null; repeated rows are treated alike; an empty table gives
    none; columns of any other name are carried along.
    """
    s = _spans(docs, support, disclose)

    def cut(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("late"), x["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("by")))

    cuts = F.concat(
        *map(cut, KINDS),
        F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("late"), x["end"].alias("end"), F.when(x["revealed"] >= remove, "").otherwise("[TERM]").alias("by"))),
    )
    marked = s.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.array_sort(cuts).alias("_cuts")).where("size(_cuts) > 0").dropDuplicates(["_id", "_h"])
    own = docs.join(marked, docs["doc_id"].eqNullSafe(marked["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == marked["_h"]), "left")
    zero = F.struct(F.lit(0).alias("at"), docs["text"].alias("t"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        fresh = c["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], acc["t"].substr(acc["at"] + 1, c["start"] - acc["at"]), c["by"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), acc["t"].alias("t"), out.alias("out"))

    new = F.when(marked["_cuts"].isNull(), docs["text"]).otherwise(F.aggregate(marked["_cuts"], zero, step, lambda a: F.concat(a["out"], a["t"].substr(a["at"] + 1, F.length(a["t"])))))
    out = own.select(*(new.alias("text") if c == "text" else docs[c] for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
