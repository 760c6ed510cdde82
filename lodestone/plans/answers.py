"""Queries that check answers; each with its SQL.

English documents stand for answers, their first three sentences, each with a number added, for claims; the three
documents behind stand for the passages S1 to S3.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answers as A
from lodestone.plans.passages import _SENTENCES, _list, _quoted
from lodestone.plans.store import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Numbers at the end of claims and passages: alike by value, alike not at all, and one in brackets.
CLAIM_NUMBERS = ["1,000", "0.50", "3.14", "12", "7 of 9"]
PASSAGE_NUMBERS = ["1000", "0.5", "3.14159", "[12] 5", "7 and 9.0"]
#: What models say for verdicts and labels.
SAID = ["ENTAILED", " entailed\n", "Contradicted", "NOT_SUPPORTED", "not supported", "", "FAITHFUL", " overstated ", "yes"]
LABELS = ["S1", "[S2]", " [S12] ", "S0", "s1", "S01", "[[S3]]", "S", "S1a", "[S 4]", "", "S99"]


def query(sql: str):
    def note(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, T.with_strip(sql)
        return f

    return note


def _pick(items: list[str], at):
    return F.get(F.array(*[F.lit(x) for x in items]), at.cast("int"))


_CASES = [
    '{"answer": " T ", "claims": [{"text": "T", "citations": ["[S1]", " [S3] "], "note": 1}], "thought": "x"}', '{"answer": "T", "claims": [], "insufficient_evidence": true}', '{"answer": "  ", "claims": []}', "T",
    '["T"]', '{"answer": "T", "claims": [{"text": "T", "citations": []}]}', '{"answer": "T", "claims": [], "insufficient_evidence": false}', '{"answer": 5, "claims": []}', '{"answer": "T", "claims": "no"}',
    '{"answer": "T", "claims": [{"text": "T", "citations": ["[S2]", " "]}]}', '{"answer": "T", "insufficient_evidence": "yes"}', '{"answer": "T", "claims": [{"text": "T", "citations": ["[S2]"]}], "insufficient_evidence": true}', '{"claims": []}', '{"answer": "T", "insufficient_evidence": true}',
    r'{"answer": "T", "claims": [{"text": "\t", "citations": ["[S1]"]}]}', r'{"answer": "T", "claims": [{"text": "T", "citations": ["\n"]}]}', r'{"answer": "\u00a0\r\n", "claims": []}', r'{"answer": "\n T\t", "claims": [{"text": "T\n", "citations": ["\t[S2]\n"]}]}',
]


@query(rf"""WITH r AS (SELECT conv_id, turn, replace({_list(_CASES)}[(conv_id * 3 + turn) % {len(_CASES)} + 1], 'T', regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')) AS raw FROM conversations WHERE role = 'assistant'),
j AS (SELECT *, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw::JSON END AS j FROM r),
c AS (SELECT *, coalesce(CASE WHEN json_type(j, '$.claims') = 'ARRAY' THEN from_json(j->'$.claims', '["JSON"]') END, []) AS claims FROM j),
v AS (SELECT *, coalesce(j IS NOT NULL AND json_type(j, '$.answer') = 'VARCHAR' AND strip(j->>'$.answer') <> '' AND coalesce(json_type(j, '$.claims'), 'ARRAY') = 'ARRAY' AND coalesce(json_type(j, '$.insufficient_evidence'), 'BOOLEAN') = 'BOOLEAN'
  AND (len(claims) = 0) = coalesce((j->>'$.insufficient_evidence') = 'true', false)
  AND len(list_filter(claims, lambda x: NOT coalesce(json_type(x, '$.text') = 'VARCHAR' AND strip(x->>'$.text') <> '' AND json_array_length(x, '$.citations') > 0 AND len(list_filter(from_json(x->'$.citations', '["VARCHAR"]'), lambda l: strip(l) = '')) = 0, false))) = 0, false) AS valid FROM c)
SELECT conv_id, turn, CASE WHEN valid THEN 'PARSED' ELSE 'REJECTED' END AS verdict, CASE WHEN valid THEN strip(j->>'$.answer') END AS answer, CASE WHEN valid THEN coalesce((j->>'$.insufficient_evidence') = 'true', false) END AS insufficient,
CASE WHEN valid THEN array_to_string(list_transform(claims, lambda x: array_to_string(list_transform(from_json(x->'$.citations', '["VARCHAR"]'), lambda l: strip(l)), '+')), ',') END AS cited FROM v""")
def answer_parse(spark, sf_dir):
    """What models wrote, read as answers with claims, or rejected."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    raw = F.replace(_pick(_CASES, (F.col("conv_id") * 3 + F.col("turn")) % len(_CASES)), F.lit("T"), F.regexp_replace("text", "[^A-Za-z0-9 ]", ""))
    found = rows.select("conv_id", "turn", A.parsed_answer(raw).alias("a"))
    cited = F.array_join(F.transform("a.claims", lambda c: F.array_join(c["citations"], "+")), ",")
    return found.select("conv_id", "turn", F.when(F.col("a.valid"), "PARSED").otherwise("REJECTED").alias("verdict"), "a.answer", "a.insufficient", cited.alias("cited"))


@query(f"""SELECT event_id, CASE WHEN upper(trim(raw, ' ' || chr(10))) IN ('ENTAILED','CONTRADICTED','NOT_SUPPORTED') THEN upper(trim(raw, ' ' || chr(10))) END AS status, CASE WHEN upper(trim(raw, ' ' || chr(10))) IN ('FAITHFUL','OVERSTATED') THEN upper(trim(raw, ' ' || chr(10))) END AS fidelity
FROM (SELECT event_id, {_list(SAID)}[event_id % {len(SAID)} + 1] AS raw FROM events)""")
def verdict_parse(spark, sf_dir):
    """One-word verdicts, read without regard to case and space; null where they can't be read."""
    raw = _pick(SAID, F.col("event_id") % len(SAID))
    return table(spark, sf_dir, "events").select("event_id", A.verdict(raw, A.SUPPORTED).alias("status"), A.verdict(raw, A.FIDELITY).alias("fidelity"))


@query(f"""SELECT event_id, CASE WHEN regexp_full_match(trim(trim(raw), '[]'), 'S[1-9][0-9]*') THEN substr(trim(trim(raw), '[]'), 2)::BIGINT END AS number FROM (SELECT event_id, {_list(LABELS)}[event_id % {len(LABELS)} + 1] AS raw FROM events)""")
def label_parse(spark, sf_dir):
    """Numbers of citation labels; null where a label is malformed."""
    return table(spark, sf_dir, "events").select("event_id", A.label_number(_pick(LABELS, F.col("event_id") % len(LABELS))).alias("number"))


_CLAIMS = rf"""SELECT doc_id AS answer_id, (k - 1)::INTEGER AS claim, s || ' ' || {_list(CLAIM_NUMBERS)}[(doc_id + k) % 5 + 1] AS text,
CASE WHEN (doc_id + k) % 11 = 0 THEN ['[S9]', '[S10]'] WHEN (doc_id + k) % 3 = 0 THEN ['[S' || (1 + (doc_id + k) % 2) || ']', '[S8]', '[S7]'] ELSE ['[S' || (1 + (doc_id + k) % 3) || ']', '[S' || (1 + (doc_id + k + 1) % 3) || ']'] END AS citations
FROM (SELECT doc_id, unnest(list_slice({_SENTENCES}, 1, 3)) AS s, generate_subscripts(list_slice({_SENTENCES}, 1, 3), 1) AS k FROM documents WHERE lang = 'en')"""
_PASSAGES = f"""SELECT a.doc_id AS answer_id, '[S' || i || ']' AS label, d.doc_id AS chunk_id, d.source, d.text || ' ' || {_list(PASSAGE_NUMBERS)}[d.doc_id % 5 + 1] AS text
FROM (SELECT doc_id, unnest([1, 2, 3]) AS i FROM documents WHERE lang = 'en') a JOIN documents d ON d.doc_id = a.doc_id + i"""
_VERDICTS = """SELECT answer_id, claim, label, CASE WHEN (answer_id * 7 + claim * 3 + substr(label, 3, 1)::INTEGER) % 10 < 6 THEN 'ENTAILED' WHEN (answer_id * 7 + claim * 3 + substr(label, 3, 1)::INTEGER) % 10 < 9 THEN 'NOT_SUPPORTED' ELSE 'CONTRADICTED' END AS status FROM (SELECT answer_id, claim, unnest(citations) AS label FROM claims)"""
_BASE = rf"""WITH claims AS MATERIALIZED ({_CLAIMS}), passages AS MATERIALIZED ({_PASSAGES}), verdicts AS ({_VERDICTS}),
labels AS MATERIALIZED (SELECT c.*, p.label IS NOT NULL AS known FROM (SELECT answer_id, claim, unnest(citations) AS label, generate_subscripts(citations, 1) AS place FROM claims) c LEFT JOIN (SELECT DISTINCT answer_id, label FROM passages) p USING (answer_id, label)),
fab AS (SELECT answer_id, claim, coalesce(list_sort(list(DISTINCT label) FILTER (NOT known)), []) AS fabricated, count(DISTINCT label) FILTER (known) AS n_real FROM labels GROUP BY ALL),
numbers AS (SELECT answer_id, label, list_transform(regexp_extract_all(regexp_replace(text, '\[[^\]]*\]', ' ', 'g'), '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')::DOUBLE) AS v FROM passages),
available AS (SELECT l.answer_id, l.claim, flatten(list(n.v)) AS v FROM labels l JOIN numbers n USING (answer_id, label) GROUP BY ALL),
numeric_ AS (SELECT c.answer_id, c.claim, list_filter(regexp_extract_all(regexp_replace(text, '\[[^\]]*\]', ' ', 'g'), '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: NOT list_contains(coalesce(a.v, []), replace(x, ',', '')::DOUBLE)) AS unsupported FROM claims c LEFT JOIN available a USING (answer_id, claim)),
status AS (SELECT c.answer_id, c.claim, CASE max(CASE WHEN l.known THEN CASE v.status WHEN 'ENTAILED' THEN 2 WHEN 'CONTRADICTED' THEN 1 ELSE 0 END END) WHEN 2 THEN 'ENTAILED' WHEN 1 THEN 'CONTRADICTED' ELSE 'NOT_SUPPORTED' END AS status
  FROM claims c LEFT JOIN labels l USING (answer_id, claim) LEFT JOIN verdicts v ON v.answer_id = l.answer_id AND v.claim = l.claim AND v.label = l.label GROUP BY ALL),
checks AS MATERIALIZED (SELECT * FROM claims JOIN fab USING (answer_id, claim) JOIN numeric_ USING (answer_id, claim) JOIN status USING (answer_id, claim)),
answers AS (SELECT doc_id AS answer_id, doc_id % 17 = 0 AS insufficient, CASE doc_id % 4 WHEN 0 THEN 'FAITHFUL' WHEN 1 THEN 'OVERSTATED' END AS fidelity FROM documents WHERE lang = 'en') """


def _claims(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.posexplode(F.slice(T.sentences(F.col("text")), 1, 3)).alias("claim", "s"))
    k = F.col("doc_id") + F.col("claim") + 1
    label = lambda n: F.concat(F.lit("[S"), n.cast("string"), F.lit("]"))
    cited = (
        F.when(k % 11 == 0, F.array(F.lit("[S9]"), F.lit("[S10]")))
        .when(k % 3 == 0, F.array(label(1 + k % 2), F.lit("[S8]"), F.lit("[S7]")))
        .otherwise(F.array(label(1 + k % 3), label(1 + (k + 1) % 3)))
    )
    return rows.select(F.col("doc_id").alias("answer_id"), "claim", F.concat("s", F.lit(" "), _pick(CLAIM_NUMBERS, k % 5)).alias("text"), cited.alias("citations"))


def _passages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("lang = 'en'").select(F.col("doc_id").alias("answer_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("i")).withColumn("doc_id", F.col("answer_id") + F.col("i"))
    met = asked.join(docs.select("doc_id", "source", "text"), "doc_id")
    return met.select("answer_id", F.concat(F.lit("[S"), F.col("i").cast("string"), F.lit("]")).alias("label"), F.col("doc_id").alias("chunk_id"), "source", F.concat("text", F.lit(" "), _pick(PASSAGE_NUMBERS, F.col("doc_id") % 5)).alias("text"))


def _verdicts(claims):
    each = claims.select("answer_id", "claim", F.explode("citations").alias("label"))
    mark = (F.col("answer_id") * 7 + F.col("claim") * 3 + F.substring("label", 3, 1).cast("int")) % 10
    return each.withColumn("status", F.when(mark < 6, "ENTAILED").when(mark < 9, "NOT_SUPPORTED").otherwise("CONTRADICTED"))


def _answers(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").where("lang = 'en'").select(d.alias("answer_id"), (d % 17 == 0).alias("insufficient"), F.when(d % 4 == 0, "FAITHFUL").when(d % 4 == 1, "OVERSTATED").alias("fidelity"))


def _checks(spark, sf_dir):
    claims = _claims(spark, sf_dir)
    return A.checked(claims, _passages(spark, sf_dir), _verdicts(claims))


@query(_BASE + """SELECT answer_id, claim, label, chunk_id, source, (row_number() OVER (PARTITION BY answer_id ORDER BY claim, place) - 1)::INTEGER AS citation_order FROM labels JOIN passages USING (answer_id, label)""")
def citations(spark, sf_dir):
    """One row for each label of a claim that names a passage, in the order of the answer."""
    found = A.citations(_claims(spark, sf_dir), _passages(spark, sf_dir))
    return found.select("answer_id", "claim", "label", "chunk_id", "source", "citation_order")


@query(_BASE + "SELECT answer_id, claim, array_to_string(fabricated, ',') AS fabricated, n_real FROM fab")
def fabricated(spark, sf_dir):
    """Labels of every claim that no passage has."""
    found = A.fabricated(A.cited_labels(_claims(spark, sf_dir), _passages(spark, sf_dir)))
    return found.select("answer_id", "claim", F.array_join("fabricated", ",").alias("fabricated"), "n_real")


@query(_BASE + "SELECT answer_id, claim, array_to_string(unsupported, ';') AS unsupported FROM numeric_")
def numbers_by_value(spark, sf_dir):
    """Numbers of every claim that no passage it cites has, whatever their spelling."""
    found = A.unsupported_numbers(_claims(spark, sf_dir), _passages(spark, sf_dir))
    return found.select("answer_id", "claim", F.array_join("unsupported", ";").alias("unsupported"))


@query(_BASE + "SELECT answer_id, claim, status FROM status")
def claim_status(spark, sf_dir):
    """The status of every claim from the verdicts on the passages it really cites."""
    return _checks(spark, sf_dir).select("answer_id", "claim", "status")


@query(_BASE + """SELECT a.answer_id, CASE WHEN any_value(insufficient) THEN 'INSUFFICIENT_EVIDENCE' WHEN coalesce(bool_or(n_real = 0 OR status = 'CONTRADICTED'), false) THEN 'REJECTED'
WHEN coalesce(bool_or(len(fabricated) > 0 OR status = 'NOT_SUPPORTED' OR len(unsupported) > 0), false) OR coalesce(any_value(fidelity) = 'OVERSTATED', false) THEN 'REPAIRABLE' ELSE 'VALID' END AS decision FROM answers a LEFT JOIN checks c USING (answer_id) GROUP BY a.answer_id""")
def answer_decisions(spark, sf_dir):
    """What becomes of every answer: all checks together."""
    return A.decisions(_answers(spark, sf_dir), _checks(spark, sf_dir))


@query(_BASE + f""", marked AS (SELECT *, status = 'ENTAILED' AND len(fabricated) = 0 AND len(unsupported) = 0 AS stands FROM checks)
SELECT answer_id, body || CASE WHEN missing IS NULL THEN '' ELSE chr(10) || chr(10) || {_quoted(A.MISSING)} || missing || {_quoted(A.UPLOAD)} END AS answer, kept::INTEGER AS kept, dropped::INTEGER AS dropped FROM (
SELECT answer_id, string_agg(text, ' ' ORDER BY claim) FILTER (stands) AS body, string_agg(text, ' ' ORDER BY claim) FILTER (NOT stands) AS missing, count(*) FILTER (stands) AS kept, count(*) FILTER (NOT stands) AS dropped, bool_or(status = 'CONTRADICTED') AS against FROM marked GROUP BY answer_id) WHERE NOT against AND kept > 0""")
def partial_answer(spark, sf_dir):
    """What stands of answers that can't be kept whole, and what was left out."""
    return A.partial_answers(_checks(spark, sf_dir))


@query(_BASE + f""", bullets AS (
SELECT answer_id, 0 AS part, claim, 0 AS place, 'Claim "' || text || '" cited ' || array_to_string(fabricated, ', ') || ', which ' || CASE WHEN len(fabricated) > 1 THEN 'do' ELSE 'does' END || ' not appear {A.NOT_PRESENT}' AS b FROM checks WHERE len(fabricated) > 0
UNION ALL SELECT answer_id, 0, claim, 1, 'Claim "' || text || '" {A.UNSUPPORTED}' FROM checks WHERE status = 'NOT_SUPPORTED'
UNION ALL SELECT answer_id, 1, claim, 0, 'Claim "' || text || '" uses ' || array_to_string(unsupported, ', ') || ', which ' || CASE WHEN len(unsupported) > 1 THEN 'do' ELSE 'does' END || ' not appear in {A.FIGURES}' FROM checks WHERE len(unsupported) > 0
UNION ALL SELECT answer_id, 2, 0, 0, '{A.OVERSTATED}' FROM answers WHERE fidelity = 'OVERSTATED')
SELECT a.answer_id, coalesce('{A.REPAIR}' || chr(10) || string_agg('- ' || b, chr(10) ORDER BY part, claim, place), '') AS instructions FROM answers a LEFT JOIN bullets USING (answer_id) GROUP BY a.answer_id""")
def repair_text(spark, sf_dir):
    """What the model is told to mend in every answer."""
    return A.repairs(_answers(spark, sf_dir), _checks(spark, sf_dir))
