"""Checks of generated answers: what they say, what they cite, and what can be kept of them.

Answers are rows, their claims rows of (answer_id, claim, text, citations) with citations in order, passages rows of
(answer_id, label, text, ...), verdicts rows of (answer_id, claim, label, status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import strip

# What repairs and partial answers say.
SUPPORTED = ["ENTAILED", "CONTRADICTED", "NOT_SUPPORTED"]
FIDELITY = ["FAITHFUL", "OVERSTATED"]
NOT_PRESENT = "in the reference passages. Use only the labels shown beside each passage."
UNSUPPORTED = "is not supported by any passage it cites. Either cite a passage that actually contains this information, or remove the claim entirely."
FIGURES = "any passage it cites. Use the figures exactly as the passages write them, without rounding or converting, or drop the statement."
OVERSTATED = "Your answer states something none of your claims covers. Either rewrite the answer so it says only what the claims establish, or add a claim — with citations — for the statement you want to keep."
REPAIR = "Your previous answer requires correction. Revise it to address all of the following:"
MISSING = "There is more to your question that your material does not appear to cover. I could not find support for this, so I have left it out: "
UPLOAD = " If you expected that to be covered, the relevant pages may not have been uploaded yet."

_CLAIM = "struct<text:variant,citations:variant>"


def label_number(raw: Column) -> Column:
    """The number of a label such as S1 or [S1], or null."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"^[\[\]]+|[\[\]]+$", "")
    return F.when(bare.rlike(r"\AS[1-9][0-9]*\z"), F.substring(bare, 2, 20).cast("long"))


def verdict(raw: Column, known: list[str]) -> Column:
    """A model's one-word verdict, whatever its case and the space around it, or null."""
    word = F.upper(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    return F.when(word.isin(known), word)


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def parsed_answer(raw: Column) -> Column:
    """A struct of valid, answer, insufficient, claims (array of text and citations) from a model's JSON.

    Valid is an object with a non-blank answer, claims that each have a text and at least one non-blank citation, and a
    boolean flag that is set exactly if there are no claims; other keys don't matter.
    """
    value = F.try_parse_json(raw)
    part = lambda path: F.try_variant_get(value, path, "variant")
    text_of = lambda v: strip(F.try_variant_get(v, "$", "string"))
    claims = F.coalesce(F.try_variant_get(value, "$.claims", "array<variant>"), F.array().cast("array<variant>"))
    cited = lambda c: F.coalesce(F.try_variant_get(c, "$.citations", "array<variant>"), F.array().cast("array<variant>"))

    def right(c: Column) -> Column:
        said, labels = F.try_variant_get(c, "$.text", "variant"), F.try_variant_get(c, "$.citations", "variant")
        named = F.forall(cited(c), lambda v: (_kind(v) == "STRING") & (text_of(v) != ""))
        return (_kind(c) == "OBJECT") & (_kind(said) == "STRING") & (text_of(said) != "") & (_kind(labels) == "ARRAY") & (F.size(cited(c)) > 0) & named

    flag, list_ = part("$.insufficient_evidence"), part("$.claims")
    insufficient = F.coalesce(F.try_variant_get(value, "$.insufficient_evidence", "boolean"), F.lit(False))
    object_ = (_kind(value) == "OBJECT") & (_kind(part("$.answer")) == "STRING") & (text_of(part("$.answer")) != "")
    typed = (flag.isNull() | (_kind(flag) == "BOOLEAN")) & (list_.isNull() | (_kind(list_) == "ARRAY"))
    valid = F.coalesce(object_ & typed & F.forall(claims, lambda c: F.coalesce(right(c), F.lit(False))) & ((F.size(claims) == 0) == insufficient), F.lit(False))
    read = F.transform(claims, lambda c: F.struct(text_of(F.try_variant_get(c, "$.text", "variant")).alias("text"), F.transform(cited(c), text_of).alias("citations")))
    return F.struct(valid.alias("valid"), F.when(valid, text_of(part("$.answer"))).alias("answer"), F.when(valid, insufficient).alias("insufficient"), F.when(valid, read).alias("claims"))


def cited_labels(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """answer_id, claim, place, label, known (whether a passage with the label was sent) of every citation."""
    each = claims.select("answer_id", "claim", F.posexplode("citations").alias("place", "label"))
    sent = passages.select("answer_id", "label", F.lit(True).alias("known")).distinct()
    return each.join(sent, ["answer_id", "label"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def citations(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """The passages' columns for every citation that names one, with citation_order over the whole answer."""
    each = claims.select("answer_id", "claim", F.posexplode("citations").alias("place", "label")).withColumn("number", label_number(F.col("label")))
    met = each.join(passages.withColumn("number", label_number(F.col("label"))).drop("label"), ["answer_id", "number"])
    order = W.partitionBy("answer_id").orderBy("claim", "place")
    return met.withColumn("citation_order", F.row_number().over(order) - 1)


def fabricated(labels: DataFrame) -> DataFrame:
    """answer_id, claim, fabricated (labels that no passage has, sorted), n_real of every claim."""
    bad = F.array_sort(F.collect_set(F.when(~F.col("known"), F.col("label"))))
    return labels.groupBy("answer_id", "claim").agg(bad.alias("fabricated"), F.count_distinct(F.when(F.col("known"), F.col("label"))).alias("n_real"))


def numbers(text: Column) -> Column:
    """Numbers as written, without those in square brackets."""
    return F.regexp_extract_all(F.regexp_replace(text, r"\[[^\]]*\]", " "), F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), 0)


def values(found: Column) -> Column:
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def unsupported_numbers(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """answer_id, claim, unsupported: numbers, as written, whose values no passage has that the claim really cites."""
    cited = cited_labels(claims, passages).where("known").select("answer_id", "claim", "label").distinct()
    held = cited.join(passages.select("answer_id", "label", values(numbers(F.col("text"))).alias("v")), ["answer_id", "label"])
    available = held.groupBy("answer_id", "claim").agg(F.flatten(F.collect_list("v")).alias("available"))
    met = claims.select("answer_id", "claim", numbers(F.col("text")).alias("n")).join(available, ["answer_id", "claim"], "left")
    known = F.coalesce("available", F.array().cast("array<double>"))
    return met.select("answer_id", "claim", F.filter("n", lambda x: ~F.array_contains(known, F.replace(x, F.lit(","), F.lit("")).cast("double"))).alias("unsupported"))


def claim_status(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """answer_id, claim, status: entailed by one passage, else contradicted by one, else not supported."""
    rank = F.when(F.col("status") == "ENTAILED", 2).when(F.col("status") == "CONTRADICTED", 1).otherwise(0)
    best = verdicts.groupBy("answer_id", "claim").agg(F.max(rank).alias("best"))
    met = claims.select("answer_id", "claim").join(best, ["answer_id", "claim"], "left")
    return met.select("answer_id", "claim", F.when(F.col("best") == 2, "ENTAILED").when(F.col("best") == 1, "CONTRADICTED").otherwise("NOT_SUPPORTED").alias("status"))


def checked(claims: DataFrame, passages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every claim with fabricated, n_real, unsupported, status. Only verdicts on real passages count."""
    labels = cited_labels(claims, passages)
    real = labels.where("known").select("answer_id", "claim", "label").distinct()
    key = ["answer_id", "claim"]
    out = claims.join(fabricated(labels), key, "left").join(unsupported_numbers(claims, passages), key, "left")
    return out.join(claim_status(claims, verdicts.join(real, [*key, "label"], "left_semi")), key, "left")


def decisions(answers: DataFrame, checks: DataFrame) -> DataFrame:
    """answer_id, decision. answers: answer_id, insufficient, fidelity (null: not judged); checks: as ``checked`` gives."""
    unreal, contradicted = F.coalesce("n_real", F.lit(0)) == 0, F.col("status") == "CONTRADICTED"
    mend = (F.size("fabricated") > 0) | (F.col("status") == "NOT_SUPPORTED")
    folded = checks.groupBy("answer_id").agg(
        F.bool_or(unreal | contradicted).alias("rejected"), F.bool_or(F.when(unreal, F.lit(False)).otherwise(mend) | (F.size("unsupported") > 0)).alias("repairable")
    )
    met = answers.join(folded, "answer_id", "left")
    decision = F.when(F.col("insufficient"), "INSUFFICIENT_EVIDENCE").when(F.col("rejected"), "REJECTED").when(F.col("repairable") | (F.coalesce("fidelity", F.lit("")) == "OVERSTATED"), "REPAIRABLE").otherwise("VALID")
    return met.select("answer_id", decision.alias("decision"))


def _in_order(what: Column, when: Column) -> Column:
    """Texts of rows where ``when`` holds, in the order of their claims."""
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("claim", what.alias("x"))))), lambda s: s["x"])


def partial_answers(checks: DataFrame) -> DataFrame:
    """answer_id, answer, kept, dropped of answers of which something stands and that nothing contradicts."""
    stands = (F.col("status") == "ENTAILED") & (F.size("fabricated") == 0) & (F.size("unsupported") == 0)
    folded = checks.groupBy("answer_id").agg(F.bool_or(F.col("status") == "CONTRADICTED").alias("against"), _in_order(F.col("text"), stands).alias("k"), _in_order(F.col("text"), ~stands).alias("d"))
    body, missing = F.array_join("k", " "), F.array_join("d", " ")
    prose = F.when(F.size("d") == 0, body).otherwise(F.concat(body, F.lit("\n\n" + MISSING), missing, F.lit(UPLOAD)))
    return folded.where("not against and size(k) > 0").select("answer_id", prose.alias("answer"), F.size("k").alias("kept"), F.size("d").alias("dropped"))


def repairs(answers: DataFrame, checks: DataFrame) -> DataFrame:
    """answer_id, instructions: what to mend, claim by claim, then numbers, then the answer itself; empty without any."""
    claim = F.concat(F.lit('Claim "'), F.col("text"), F.lit('" '))
    verb = lambda c: F.when(F.size(c) > 1, " do").otherwise(" does")
    cited = F.when(F.size("fabricated") > 0, F.concat(claim, F.lit("cited "), F.array_join("fabricated", ", "), F.lit(", which"), verb("fabricated"), F.lit(f" not appear {NOT_PRESENT}")))
    held = F.when(F.col("status") == "NOT_SUPPORTED", F.concat(claim, F.lit(UNSUPPORTED)))
    figures = F.concat(claim, F.lit("uses "), F.array_join("unsupported", ", "), F.lit(", which"), verb("unsupported"), F.lit(f" not appear in {FIGURES}"))
    first = F.transform(F.array_sort(F.collect_list(F.struct("claim", F.array_compact(F.array(cited, held)).alias("x")))), lambda s: s["x"])
    folded = checks.groupBy("answer_id").agg(F.flatten(first).alias("first"), _in_order(figures, F.size("unsupported") > 0).alias("second"))
    none = F.array().cast("array<string>")
    over = F.when(F.col("fidelity") == "OVERSTATED", F.array(F.lit(OVERSTATED))).otherwise(none)
    bullets = F.concat(F.coalesce("first", none), F.coalesce("second", none), over)
    met = answers.join(folded, "answer_id", "left").withColumn("bullets", bullets)
    text = F.when(F.size("bullets") == 0, "").otherwise(F.concat(F.lit(REPAIR + "\n"), F.array_join(F.transform("bullets", lambda b: F.concat(F.lit("- "), b)), "\n")))
    return met.select("answer_id", text.alias("instructions"))
