from pyspark.sql import functions as F

from checks.base import check
from jobtide.functions import phrases as P
from jobtide.functions.status import keyword_status, page_alive, parse_response, text_gate
from jobtide.functions.text import closed_flag, spaced
from jobtide.operators import classification as C


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sum(tests) -> str:
    return " + ".join(f"CAST({t} AS INT)" for t in tests)


_ANY_CLOSED = _quoted("(?i)" + "|".join(P.CLOSED_FLAG_PATTERNS))
_TRIMMED = "regexp_replace(text, " + _quoted(f"^{P.SPACE}+|{P.SPACE}+$") + ", '', 'g')"
# counts over all phrases, with no shortcut
KEYWORDS = f"""
counts AS (
  SELECT posting_id, text, {_sum(f"regexp_matches(low, {_quoted(spaced(p))})" for p in P.EXPLICIT_CLOSED_PATTERNS)} AS e,
         {_sum(f"contains(low, {_quoted(p)})" for p in P.CLOSED_PHRASES)} AS c,
         {_sum(f"contains(low, {_quoted(p)})" for p in P.OPEN_PHRASES)} AS o
  FROM (SELECT *, lower(text) AS low FROM {{posting_texts}})),
keywords AS (
  SELECT posting_id, text,
    CASE WHEN e > 0 OR c > o THEN 'closed' WHEN o > c THEN 'open' ELSE 'unknown' END AS status,
    CASE WHEN e > 0 THEN least(0.5::DOUBLE + e * 0.2::DOUBLE, 0.95::DOUBLE)
         WHEN c <> o THEN least(0.5::DOUBLE + abs(c - o) * 0.1::DOUBLE, 0.9::DOUBLE) ELSE 0.3::DOUBLE END AS confidence,
    'keyword_fallback' AS method,
    CASE WHEN e > 0 THEN concat('Found ', e, ' explicit closed indicators') WHEN c > o THEN concat('Found ', c, ' closed indicators')
         WHEN o > c THEN concat('Found ', o, ' open indicators') ELSE 'No clear indicators found' END AS reason
  FROM counts),
finals AS (
  SELECT *, length({_TRIMMED}) < 50 AS short, confidence > 0.8::DOUBLE AS sure FROM keywords)
"""


@check("closed_flag", f"SELECT posting_id, regexp_matches(text, {_ANY_CLOSED}) AS closed FROM {{posting_texts}}")
def closed(d):
    return d.view("posting_texts").select("posting_id", closed_flag("text").alias("closed"))


@check("keyword_status", f"WITH {KEYWORDS} SELECT posting_id, status, confidence, method, reason FROM keywords")
def keywords(d):
    return d.view("posting_texts").select("posting_id", keyword_status("text").alias("v")).select("posting_id", "v.*")


@check("text_gate", f"""
SELECT doc_id, 'unknown' AS status, 0.0::DOUBLE AS confidence, 'insufficient_content' AS method
FROM {{documents}} WHERE length({_TRIMMED}) < 50
UNION ALL SELECT conv_id * 1000 + turn, 'unknown', 0.0::DOUBLE, 'insufficient_content'
FROM {{conversations}} WHERE length({_TRIMMED}) < 50
""")
def gate(d):
    turns = d.sql("SELECT doc_id, text FROM {documents} UNION ALL SELECT conv_id * 1000 + turn, text FROM {conversations}")
    gated = turns.select("doc_id", text_gate("text").alias("v")).filter("v is not null")
    return gated.select("doc_id", "v.status", "v.confidence", "v.method")


@check("build_prompts", f"""
WITH {KEYWORDS} SELECT posting_id, md5(concat({_quoted(P.PROMPT_HEAD)}, substr(text, 1, 2000), {_quoted(P.PROMPT_TAIL)})) AS digest
FROM finals WHERE NOT short AND NOT sure
""")
def build_prompts(d):
    return C.build_prompts(d.view("posting_texts")).select("posting_id", F.md5("prompt").alias("digest"))


_ANSWERS = """
SELECT conv_id, turn, concat('  ', CASE (conv_id + turn) % 6 WHEN 0 THEN 'Closed.' WHEN 1 THEN 'OPEN' WHEN 2 THEN 'It is not closed'
  WHEN 3 THEN 'not closed, it is open' WHEN 4 THEN 'Closed or open' ELSE '' END, ' ', text, ' ') AS answer FROM {conversations}"""


@check("parse_responses", f"""
SELECT conv_id, turn,
  CASE WHEN c AND NOT o AND NOT n THEN 'closed' WHEN o THEN 'open' ELSE 'unknown' END AS status,
  CASE WHEN c AND NOT o AND NOT n OR o THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN c AND NOT o AND NOT n OR o THEN 'test' ELSE 'parse_failed' END AS method
FROM (SELECT conv_id, turn, contains(lower(answer), 'closed') AS c, contains(lower(answer), 'open') AS o,
             contains(lower(answer), 'not closed') OR contains(lower(answer), 'isn''t closed') AS n FROM ({_ANSWERS}))
""")
def parse_responses(d):
    verdicts = d.sql(_ANSWERS).select("conv_id", "turn", parse_response("answer", "test").alias("v"))
    return verdicts.select("conv_id", "turn", "v.status", "v.confidence", "v.method")


# two providers with failing calls, unreadable bodies, lists, missing and null fields
_RESPONSES = """
SELECT doc_id AS posting_id, 'ai_ollama' AS provider, CASE doc_id % 5 WHEN 0 THEN 500 ELSE 200 END AS http_status,
  CASE doc_id % 7 WHEN 0 THEN '{"response": " Open "}' WHEN 1 THEN '{"response": "closed"}' WHEN 2 THEN '{"response": "maybe"}'
    WHEN 3 THEN '{"response": null}' WHEN 4 THEN '{"other": 1}' WHEN 5 THEN '{broken' ELSE '[{"response": "open"}]' END AS body
FROM {documents} WHERE lang <> 'fr'
UNION ALL
SELECT doc_id, 'ai_huggingface', CASE doc_id % 4 WHEN 0 THEN 503 ELSE 200 END,
  CASE doc_id % 3 WHEN 0 THEN '[{"generated_text": "It is closed."}]' WHEN 1 THEN '{"generated_text": "OPEN"}' ELSE '[]' END
FROM {documents} WHERE lang <> 'de'"""


@check("classify_cascade", f"""
WITH {KEYWORDS},
first AS (SELECT doc_id AS posting_id, doc_id % 7 AS k FROM {{documents}} WHERE lang <> 'fr' AND doc_id % 5 <> 0 AND doc_id % 7 IN (0, 1, 2, 4)),
second AS (SELECT doc_id AS posting_id, doc_id % 3 AS k FROM {{documents}} WHERE lang <> 'de' AND doc_id % 4 <> 0 AND doc_id % 3 IN (0, 1)),
chosen AS (
  SELECT f.*, first.k AS a, second.k AS b, CASE WHEN short THEN 's' WHEN sure THEN 'k' WHEN first.k IS NOT NULL THEN 'a'
         WHEN second.k IS NOT NULL THEN 'b' ELSE 'k' END AS way
  FROM finals f LEFT JOIN first USING (posting_id) LEFT JOIN second USING (posting_id))
SELECT posting_id,
  CASE way WHEN 's' THEN 'unknown' WHEN 'k' THEN status WHEN 'a' THEN CASE a WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'unknown' END
       ELSE CASE b WHEN 0 THEN 'closed' ELSE 'open' END END AS status,
  CASE way WHEN 's' THEN 0.0::DOUBLE WHEN 'k' THEN confidence WHEN 'a' THEN CASE WHEN a < 2 THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.85::DOUBLE END AS confidence,
  CASE way WHEN 's' THEN 'insufficient_content' WHEN 'k' THEN method WHEN 'a' THEN CASE WHEN a < 2 THEN 'ai_ollama' ELSE 'parse_failed' END
       ELSE 'ai_huggingface' END AS method,
  CASE way WHEN 'k' THEN reason END AS reason
FROM chosen
""")
def classify_cascade(d):
    return C.classify(d.view("posting_texts"), d.sql(_RESPONSES))


_FETCHED = """
SELECT posting_id, CASE posting_id % 10 WHEN 7 THEN 404 WHEN 8 THEN 410 WHEN 9 THEN 500 ELSE 200 END AS http_status,
  CASE WHEN posting_id % 9 = 1 THEN NULL WHEN posting_id % 9 = 2 THEN concat(text, ' 404  Page') WHEN posting_id % 9 = 3
  THEN concat(text, ' Job no longer EXISTS') ELSE text END AS text FROM {posting_texts}"""


@check("page_alive", f"""
SELECT posting_id, http_status NOT IN (404, 410, 403) AND text IS NOT NULL
  AND NOT coalesce(regexp_matches(text, {_quoted("(?i)" + "|".join(spaced(p) for p in P.GONE_PATTERNS))}), FALSE) AS alive
FROM ({_FETCHED})
""")
def alive(d):
    return d.sql(_FETCHED).select("posting_id", page_alive("http_status", "text").alias("alive"))
