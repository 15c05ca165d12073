"""Queries of scans, text scalars, chunks and choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import choices as R
from scholia.functions import reasoning as C
from scholia.functions import text as X
from scholia.plans.base import ITEMS_SQL, QA_SQL, items, query, questions

_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_CHUNKS = rf"""w AS (SELECT *, {_WORDS} AS w FROM documents),
c AS (SELECT doc_id, lang, source, i AS chunk_index, array_to_string(w[i * 500 + 1:i * 500 + 500], ' ') AS chunk
  FROM (SELECT *, unnest(range(0, (len(w) - 1) // 500 + 1)) AS i FROM w WHERE len(w) > 0))"""


@query("c01_chunk_fixed_words", f"WITH {_CHUNKS} SELECT doc_id, chunk_index, md5(chunk) AS chunk_md5, len(string_split(chunk, ' ')) AS n_words FROM c")
def _(spark, t):
    c = X.chunks(t("documents").select("doc_id", "text"))
    return c.select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"), F.size(F.split("chunk", " ")).alias("n_words"))


@query(
    "entry_unique_chunks",
    f"""WITH {_CHUNKS}, u AS (SELECT *, row_number() OVER (PARTITION BY md5(chunk) ORDER BY doc_id, chunk_index) AS k FROM c)
    SELECT lang, source, count(*) AS n_chunks, sum(length(chunk))::BIGINT AS n_chars FROM u WHERE k = 1 GROUP BY lang, source""",
)
def unique_chunks(spark, t):
    c = X.chunks(t("documents").select("doc_id", "lang", "source", "text"))
    # first wins by a minimum per hash: partial sums, so a common chunk is no hot group
    first = c.groupBy(X.question_hash(F.col("chunk")).alias("h")).agg(F.min(F.struct("doc_id", "chunk_index", "lang", "source", F.length("chunk").alias("n"))).alias("one"))
    return first.groupBy("one.lang", "one.source").agg(F.count("*").alias("n_chunks"), F.sum("one.n").alias("n_chars"))


@query("c02_char_chunks", "SELECT doc_id, i AS chunk_index, md5(substr(text, i * 2000 + 1, 2000)) AS chunk_md5 FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1999) // 2000)) AS i FROM documents)")
def _(spark, t):
    c = X.char_chunks(t("documents").select("doc_id", "text"))
    return c.select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


@query("c03_boundary_chunks")
def _(spark, t):
    c = X.boundary_chunks(t("documents").select("doc_id", "text"), size=1500)
    return c.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"))


@query("f01_question_hash", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
def _(spark, t):
    return t("documents").select("doc_id", X.question_hash(F.col("text")).alias("h"))


@query("f02_f03_ids", "SELECT event_id, substr(sha256(concat_ws('_', '/data/' || user_id, epoch_us(ts)::VARCHAR)), 1, 16) AS file_id, user_id::VARCHAR || '_' || lpad((event_id % 10000)::VARCHAR, 4, '0') AS chunk_id, md5('/data/' || user_id) AS paper_id, substr(md5('/data/' || user_id), 1, 8) AS short_id FROM events")
def _(spark, t):
    path = F.concat(F.lit("/data/"), F.col("user_id").cast("string"))
    ts = F.col("ts").cast("timestamp")
    return t("events").select("event_id", X.file_id(path, ts).alias("file_id"), X.chunk_id(F.col("user_id"), F.col("event_id") % 10000).alias("chunk_id"), F.md5(path).alias("paper_id"), F.substring(F.md5(path), 1, 8).alias("short_id"))


@query("f05_file_stem", r"SELECT page_id, regexp_replace(list_last(string_split(url, '/')), '\.[^.]*$', '') AS stem FROM pages")
def _(spark, t):
    return t("pages").select("page_id", X.stem(F.col("url")).alias("stem"))


@query("f06_f07_names", r"""SELECT doc_id, rtrim(regexp_replace(text, '[^\p{L}\p{N} ._]', '', 'g'), ' ') AS sanitised,
  CASE WHEN s = '' THEN 'question_' || doc_id ELSE s END AS slug FROM (SELECT *, regexp_replace(regexp_replace(substr(text, 1, 50), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM documents)""")
def _(spark, t):
    return t("documents").select("doc_id", X.sanitised(F.col("text")).alias("sanitised"), X.slug(F.col("text"), F.concat(F.lit("question_"), F.col("doc_id").cast("string"))).alias("slug"))


@query("f08_first_words", rf"SELECT doc_id, md5(CASE WHEN len(w) <= 100 THEN text ELSE array_to_string(w[1:100], ' ') END) AS h FROM (SELECT *, {_WORDS} AS w FROM documents)")
def _(spark, t):
    return t("documents").select("doc_id", F.md5(X.first_words(F.col("text"), 100)).alias("h"))


@query("f09_truncate", """WITH h AS (SELECT doc_id, text, substr(text, 1, 1000) AS h FROM documents),
  p AS (SELECT *, CASE WHEN instr(reverse(h), '.') > 0 THEN length(h) - instr(reverse(h), '.') ELSE -1 END AS p FROM h)
  SELECT doc_id, md5(CASE WHEN length(text) <= 1000 THEN text ELSE CASE WHEN p > 800 THEN substr(h, 1, p + 1) ELSE h END || chr(10) || chr(10) || '[Content truncated for analysis]' END) AS h FROM p""")
def _(spark, t):
    return t("documents").select("doc_id", F.md5(X.truncated(F.col("text"), 1000)).alias("h"))


_PRE = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'),
  'http\S+|www\S+|https\S+', '', 'g'), '\S*@\S*\s?', '', 'g'), '\[\d+(?:,\s*\d+)*\]', '', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\d+', '', 'g')), '\s+', ' ', 'g'))"""
STOP = ("the", "and", "for", "that", "with", "this", "from", "are", "was", "not", "but", "les", "des", "une", "que", "los", "las", "der", "die", "das", "und")
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


@query("f10_preprocess", f"SELECT doc_id, {_PRE} AS clean FROM documents")
def _(spark, t):
    return t("documents").select("doc_id", X.preprocessed(F.col("text")).alias("clean"))


@query("f11_tokens", f"SELECT doc_id, len(k)::INT AS n_tokens, array_to_string(k[1:20], ' ') AS head FROM (SELECT doc_id, list_filter(string_split({_PRE}, ' '), lambda x: length(x) > 2 AND x NOT IN ({_STOP_SQL})) AS k FROM documents)")
def _(spark, t):
    k = X.content_tokens(F.col("text"), STOP)
    return t("documents").select("doc_id", F.size(k).alias("n_tokens"), F.array_join(F.slice(k, 1, 20), " ").alias("head"))


_DIRTY = "'The question is clear and ' || text || ' This question tests it. Pick option B (C) . . In summary this ends. Done.'"
_CLEANED = _DIRTY
for _p in X.BOILER_PLATE:
    _CLEANED = f"regexp_replace({_CLEANED}, '(?is){_p}', '', 'g')"
for _p in (r"\([A-Z]\)", r"choice\s+[A-Z]", r"option\s+[A-Z]"):
    _CLEANED = f"regexp_replace({_CLEANED}, '{_p}', '', 'g')"


@query("f12_clean_answer", rf"SELECT doc_id, trim(regexp_replace(regexp_replace({_CLEANED}, '\s+', ' ', 'g'), '\s*\.\s*\.', '.', 'g')) AS clean FROM documents")
def _(spark, t):
    return t("documents").select("doc_id", X.cleaned_answer(F.expr(_DIRTY)).alias("clean"))


@query("f14_option_number", rf"WITH {ITEMS_SQL}, a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN option || ' (Option ' || k || ')' ELSE '  ' || option || ' ' END AS a FROM items) SELECT doc_id, coalesce(nullif(regexp_extract(a, '\(Option (\d+)\)', 1), ''), trim(a)) AS n FROM a")
def _(spark, t):
    a = F.when(F.col("doc_id") % 2 == 0, F.concat("option", F.lit(" (Option "), F.col("k").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("  "), "option", F.lit(" ")))
    return items(t).select("doc_id", X.option_number(a).alias("n"))


@query("f17_short_label", "SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN substr(split_part(p_name, ' ', 1), 1, 4) || substr(split_part(p_name, ' ', 2), 1, 4) ELSE substr(p_name, 1, 8) END AS label FROM part")
def _(spark, t):
    return t("part").select("p_partkey", X.short_label(F.col("p_name")).alias("label"))


@query("f18_keyword_fallback", r"""WITH k AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{4,}')) AS k FROM documents),
  u AS (SELECT doc_id, list_filter(k, lambda x, i: x NOT IN ('that', 'with', 'this') AND list_position(k, x) = i) AS u FROM k)
  SELECT doc_id, array_to_string(u[1:6], ',') AS words FROM u""")
def _(spark, t):
    return t("documents").select("doc_id", F.array_join(X.keyword_fallback(F.col("text"), ("that", "with", "this")), ",").alias("words"))


@query("f22_duration", """SELECT event_id, CASE WHEN s < 60 THEN printf('%.2f seconds', s) WHEN s < 3600 THEN printf('%.2f minutes', s / 60) WHEN s < 86400 THEN printf('%.2f hours', s / 3600)
  ELSE printf('%.2f days', s / 86400) END AS told FROM (SELECT event_id, (event_id * 37 % 200000 + 0.123)::DOUBLE AS s FROM events)""")
def _(spark, t):
    return t("events").select("event_id", X.duration_text((F.col("event_id") * 37 % 200000 + 0.123).cast("double")).alias("told"))


@query("f31_labelled_fields", r"""WITH r AS (SELECT doc_id, 'RELEVANCE_SCORE: ' || (doc_id % 11) || '.7' || chr(10) || 'REASONING: ' || lang || ' text' || chr(10) || 'CONTENT_TYPE: ' || source AS r FROM documents)
  SELECT doc_id, coalesce(nullif(regexp_extract(r, 'RELEVANCE_SCORE:\s*(\d+(?:\.\d+)?)', 1), '')::DOUBLE, 5)::DOUBLE AS s0, trunc(regexp_extract(r, 'RELEVANCE_SCORE:\s*(\d+(?:\.\d+)?)', 1)::DOUBLE)::INT AS score,
  split_part(split_part(r, 'REASONING: ', 2), chr(10), 1) AS reasoning, split_part(r, 'CONTENT_TYPE: ', 2) AS kind FROM r""")
def _(spark, t):
    r = F.concat(F.lit("RELEVANCE_SCORE: "), (F.col("doc_id") % 11).cast("string"), F.lit(".7\nREASONING: "), "lang", F.lit(" text\nCONTENT_TYPE: "), "source")
    d = t("documents").select("doc_id", r.alias("r"))
    return d.select("doc_id", F.regexp_extract("r", r"RELEVANCE_SCORE:\s*(\d+(?:\.\d+)?)", 1).cast("double").alias("s0"), X.score_field(F.col("r"), "RELEVANCE_SCORE", 5).alias("score"), X.labelled_field(F.col("r"), "REASONING", ("CONTENT_TYPE",)).alias("reasoning"), X.labelled_field(F.col("r"), "CONTENT_TYPE").alias("kind"))


@query("p02_question_answer_text", f"WITH {QA_SQL} SELECT conv_id, turn, 'Question: ' || trim(question, ' ') || chr(10) || 'Answer: ' || trim(answer, ' ') AS text FROM qa")
def _(spark, t):
    return questions(t).select("conv_id", "turn", X.question_answer_text(F.col("question"), F.col("answer")).alias("text"))


@query("p03_strip_marker", f"WITH {ITEMS_SQL} SELECT doc_id, replace(question, '(*)', '') AS question, replace(option || '(*)', '(*)', '') AS nested FROM items")
def _(spark, t):
    d = items(t).select("doc_id", "question", F.array(F.struct(F.concat("option", F.lit("(*)")).alias("o"))).alias("n"))
    return X.without_literal(d).select("doc_id", "question", F.col("n")[0]["o"].alias("nested"))


@query("f33_mc_format", f"WITH {ITEMS_SQL} SELECT doc_id, md5(question) AS h, answer FROM items")
def _(spark, t):
    return items(t).select("doc_id", F.md5("question").alias("h"), "answer")


@query("s12_title", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10))[1:10] AS l FROM documents)
  SELECT doc_id, coalesce(trim(list_filter(l, lambda x: length(trim(x, ' ')) > 10)[1], ' '), 'd' || doc_id) AS title FROM l""")
def _(spark, t):
    return t("documents").select("doc_id", X.title(F.col("text"), F.concat(F.lit("/x/d"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("title"))


_STYLE = r"(?:^|\n)\s*([1-5])[.):,]\s"


@query("r01_identifier_style", rf"WITH {ITEMS_SQL} SELECT doc_id, CASE WHEN regexp_matches(question, '{_STYLE}') THEN 'number' ELSE 'letter' END AS style FROM items")
def _(spark, t):
    return items(t).select("doc_id", R.identifier_style(F.col("question")).alias("style"))


def _ans(doc_id="doc_id"):
    return f"""CASE {doc_id} % 8 WHEN 0 THEN 'The correct answer is ' || substr('ABCDE', ({doc_id} % 5 + 1)::INT, 1) || '.' WHEN 1 THEN 'Option 3 seems right' WHEN 2 THEN 'I say 4) because'
    WHEN 3 THEN '2. it is' WHEN 4 THEN 'D is correct' WHEN 5 THEN 'So we get 5' WHEN 6 THEN 'none of them' ELSE 'Hm.' || chr(10) || 'B) ' || lang END"""


def _cascade(kind: str, x: str) -> list[str]:
    st = rf"(?i)(?:the\s+(?:correct\s+)?answer\s+is\s+([{x}]))|(?:\b([{x}])\s+is\s+(?:the\s+)?correct)"
    return [rf"(?i)(?:^|\n)\s*([{x}])[.):]\s", rf"(?i)(?:option|answer|choice)\s+([{x}])\b", st]


def _choice_sql() -> str:
    def first(p: str, g: int = 1, c: str = "a") -> str:
        return f"nullif(regexp_extract({c}, '{p}', {g}), '')"

    out = []
    for kind, x in (("letter", "A-E"), ("number", "1-5")):
        a, b, c = _cascade(kind, x)
        out.append((kind, f"coalesce({first(a)}, {first(b)}, {first(c)}, {first(c, 2)})"))
    line = "trim(string_split(a, chr(10))[1], ' ')"
    for kind, x in (("letter", "A-E"), ("number", "1-5")):
        out.append((kind, first(rf"(?i)^([{x}])(?:[.):,]|\s|$)", 1, line)))
    for kind, x in (("letter", "A-E"), ("number", "1-5")):
        out.append((kind, f"CASE WHEN length(a) < 100 THEN {first(rf'(?i)\b([{x}])\b')} END"))
    kinds = "CASE " + " ".join(f"WHEN {e} IS NOT NULL THEN '{k}'" for k, e in out) + " END"
    ids = "upper(coalesce(" + ", ".join(e for _, e in out) + "))"
    return f"SELECT doc_id, {kinds} AS kind, {ids} AS id FROM (SELECT doc_id, {_ans()} AS a FROM documents)"


@query("r02_choice_cascade", _choice_sql())
def _(spark, t):
    c = R.choice(F.expr(_ans().replace("::INT", "").replace("chr(10)", "'\\n'").replace("(doc_id % 5 + 1)", "cast(doc_id % 5 + 1 as int)")))
    return t("documents").select("doc_id", c["kind"].alias("kind"), c["id"].alias("id"))


@query("r04_normalise_choice", "SELECT n_nationkey, CASE WHEN n_nationkey + 1 <= 26 THEN chr(65 + n_nationkey) END AS letter, (n_nationkey + 1)::VARCHAR AS number FROM nation")
def _(spark, t):
    n = t("nation").select("n_nationkey", (F.col("n_nationkey") + 1).cast("string").alias("i"))
    d = n.withColumn("letter", R.normalised_choice(F.lit("number"), F.col("i"), "letter"))
    return d.select("n_nationkey", "letter", R.normalised_choice(F.lit("letter"), F.col("letter"), "number").alias("number"))


@query("r05_option_content", f"WITH {ITEMS_SQL} SELECT doc_id, CASE WHEN k = doc_id % 5 + 1 THEN option || ' (*)' END AS content FROM items")
def _(spark, t):
    return items(t).select("doc_id", R.option_content(F.col("question"), F.col("k").cast("string")).alias("content"))


@query("r06_options", f"WITH {ITEMS_SQL} SELECT items.doc_id, array_to_string(list_transform(range(2, 7), lambda i: w.w[i]), '|') AS options, k AS correct FROM items JOIN w USING (doc_id)")
def _(spark, t):
    return items(t).select("doc_id", F.array_join(R.options(F.col("question")), "|").alias("options"), R.correct_option(F.col("question")).alias("correct"))


_OUT = "'Started' || chr(10) || 'Overall accuracy: ' || (o_orderkey % 101) || '.25% (44/50)' || chr(10) || 'Average MC confidence: 0.' || (o_orderkey % 9 + 1)"


@query("r08_stdout_metrics", rf"""SELECT o_orderkey, nullif(regexp_extract(s, 'Overall accuracy: ([\d.]+)%', 1), '')::DOUBLE AS accuracy, nullif(regexp_extract(s, 'Average MC confidence: ([\d.]+)', 1), '')::DOUBLE AS confidence
  FROM (SELECT o_orderkey, {_OUT} AS s FROM orders)""")
def _(spark, t):
    s = F.expr(_OUT.replace("chr(10)", "'\\n'"))
    return t("orders").select("o_orderkey", R.stdout_metric(s, r"Overall accuracy: ([\d.]+)%").alias("accuracy"), R.stdout_metric(s, r"Average MC confidence: ([\d.]+)").alias("confidence"))


@query("r13_r14_embedded_options", rf"WITH {ITEMS_SQL} SELECT doc_id, len(list_filter(string_split(question, chr(10)), lambda l: regexp_matches(trim(l, ' '), '^[1-9][.)]'))) > 0 AS embedded, nullif(regexp_extract(answer, '\b(\d+)\b', 1), '') AS n, trim(substr(trim(question, ' '), 1, 100), ' ') AS print FROM items")
def _(spark, t):
    return items(t).select("doc_id", R.has_embedded_options(F.col("question")).alias("embedded"), R.first_integer(F.col("answer")).alias("n"), R.fingerprint(F.col("question")).alias("print"))


@query("u06_word_overlap", rf"""WITH {QA_SQL}, x AS (SELECT conv_id, turn, trim(lower(regexp_replace(question, '\s+', ' ', 'g'))) AS o, trim(lower(regexp_replace(answer, '\s+', ' ', 'g'))) AS a FROM qa),
  y AS (SELECT *, list_distinct(regexp_extract_all(o, '([\p{{L}}\p{{N}}_]+)', 1)) AS ow, list_distinct(regexp_extract_all(a, '([\p{{L}}\p{{N}}_]+)', 1)) AS aw FROM x)
  SELECT conv_id, turn, CASE WHEN length(o) > 15 AND len(ow) > 0 THEN len(list_intersect(ow, aw)) / len(ow) >= 0.6 ELSE contains(a, o) END AS consistent FROM y""")
def _(spark, t):
    return questions(t).select("conv_id", "turn", R.word_overlap(F.col("question"), F.col("answer")).alias("consistent"))


_FLOW_SQL = "CASE " + " ".join(f"WHEN regexp_matches(s, '(?i){p}') THEN '{k}'" for k, p in C.FLOW) + " ELSE 'ELABORATION' END"
#: documents made of reasoning sentences and their own words
_REASON = """'Let me think about ' || lang || '. First, maybe it is ' || text || '! However, I think the evidence shows it, because x causes y. So therefore I believe the answer is ' || source || '. Actually, wait, probably not?'"""
_SENT = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 10)"


def reasoned(t):
    return t("documents").select("doc_id", "lang", "source", F.expr(_REASON).alias("text"))


REASONED_SQL = f"rs AS (SELECT doc_id, lang, source, {_REASON} AS text FROM documents)"
FLOW_SQL = f"fl AS (SELECT doc_id, lang, source, i, {_FLOW_SQL} AS step FROM (SELECT doc_id, lang, source, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM (SELECT *, {_SENT} AS ss FROM rs)))"


@query("c07_flow_labels", f"WITH {REASONED_SQL}, {FLOW_SQL} SELECT doc_id, string_agg(step, '->' ORDER BY i) AS flow FROM fl GROUP BY doc_id")
def _(spark, t):
    return reasoned(t).select("doc_id", F.array_join(C.flow(F.col("text")), "->").alias("flow"))


def _hits_sql(kind: str) -> str:
    n = " + ".join(rf"len(regexp_extract_all(text, '(?i){p.replace(chr(39), chr(39) * 2)}'))" for p in C.PATTERNS[kind])
    return n


@query("c06_pattern_counts", f"WITH {REASONED_SQL} SELECT doc_id, " + ", ".join(f"({_hits_sql(k)})::INT AS n_{k}" for k in C.PATTERNS) + " FROM rs")
def _(spark, t):
    return reasoned(t).select("doc_id", *(C.pattern_count(F.col("text"), k).alias(f"n_{k}") for k in C.PATTERNS))


@query("c06_pattern_hits")
def _(spark, t):
    h = reasoned(t).select("doc_id", F.explode(C.pattern_hits(F.col("text"), "uncertainty")).alias("h"))
    return h.select("doc_id", "h.type", "h.text", "h.confidence", "h.position", "h.context")


@query("c09_structure_features")
def _(spark, t):
    s = reasoned(t).select("doc_id", C.outline(F.col("text")).alias("s"))
    return s.select("doc_id", *(c.alias(k) for k, c in C.features(F.col("s")).items()))


def _has(markers) -> str:
    return "(" + " OR ".join(f"contains(s, '{m}')" for m in markers) + ")"


_CERT = "CASE " + " ".join(f"WHEN {_has(m)} THEN {v}::DOUBLE" for v, m in C.CERTAINTY) + " ELSE 0.7::DOUBLE END"
_QUANT = "CASE " + " ".join(f"WHEN contains(s, '{m}') THEN '{k}:{m}'" for k, ms in C.QUANTIFIERS for m in ms) + " END"
_COND = "CASE WHEN contains(s, 'if') AND contains(s, 'then') THEN 'if_then' WHEN contains(s, 'if') THEN 'if_implicit' WHEN contains(s, 'when') THEN 'when' WHEN contains(s, 'unless') THEN 'unless' WHEN contains(s, 'provided') OR contains(s, 'given that') THEN 'provided' WHEN contains(s, 'assuming') THEN 'assuming' END"


@query("f23_f27_clause_features", f"""WITH {REASONED_SQL}, se AS (SELECT doc_id, generate_subscripts(ss, 1) AS ord, unnest(ss) AS t FROM (SELECT *, {_SENT} AS ss FROM rs)), x AS (SELECT *, lower(t) AS s FROM se)
  SELECT doc_id, ord, regexp_matches(regexp_replace(t, '[À-ɏ]', 'x', 'g'), '{C.NEGATION.replace(chr(39), chr(39) * 2)}') AS negated, {_CERT} AS certainty, {_QUANT} AS quantifier, {_COND} AS conditional FROM x""")
def _(spark, t):
    s = reasoned(t).select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("ord", "t"))
    c = F.col("t")
    return s.select("doc_id", (F.col("ord") + 1).alias("ord"), C.negated(c).alias("negated"), C.certainty(c).alias("certainty"), C.quantifier(c).alias("quantifier"), C.conditional_type(c).alias("conditional"))


_STREAM = "'Intro' || chr(10) || repeat('=', 80) || chr(10) || 'QUESTION 1: x' || chr(10) || 'STREAM OF THOUGHT:' || chr(10) || repeat('-', 40) || chr(10) || text || chr(10) || repeat('=', 80) || chr(10) || 'END'"


@query("s20_stream_body", rf"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents")
def _(spark, t):
    return t("documents").select("doc_id", C.stream_body(F.expr(_STREAM.replace("chr(10)", "'\\n'"))).alias("body"))
