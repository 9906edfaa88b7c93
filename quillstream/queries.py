"""The catalogue of the library's own queries over the driver's tables, with DuckDB SQL for each that SQL can express.

Readings of the tables: `documents` are transcripts, and by `source` parts of a lecture in order of doc_id
with n_chars as duration; turns of `conversations` and their next turns are pairs of source and
rewritten text; `events` is a log of jobs (user: client, event_type: stage or status, value: seconds,
props.k: progress).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstream.functions import urls
from quillstream.functions import languages as lg
from quillstream.functions import text as tx
from quillstream.functions.columns import let
from quillstream.operators import layout, markdown, votes
from quillstream.plans import limits, progress, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents")


def _r6(c):
    return F.round(c, 6)


# DuckDB's regular expressions know ASCII classes only, so white space is spelt out.
_WS = r"[\t\n\x0b\f\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TOKENS = f"list_filter(string_split_regex(coalesce(text, ''), '{_WS}'), lambda x: x <> '')"
_AR = r"[\x{621}-\x{63a}\x{641}-\x{64a}\x{66e}\x{66f}\x{671}-\x{6d3}\x{6d5}\x{6ee}\x{6ef}\x{6fa}-\x{6fc}\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8c9}\x{fb50}-\x{fdfb}\x{fe70}-\x{fefc}]"
_LA = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"


def _count(pattern: str, column: str = "text") -> str:
    return f"len(regexp_extract_all(coalesce({column}, ''), '{pattern}'))"


@_query(f"""
WITH l AS (SELECT doc_id, lang, {_count(_AR)} AS a, {_count(_AR)} + {_count(_LA)} AS n FROM documents)
SELECT doc_id, n::INTEGER AS letters, round(CASE WHEN n > 0 THEN a::DOUBLE / n ELSE 0 END, 6) AS arabic_share,
  CASE WHEN n >= 20 THEN CASE WHEN a::DOUBLE / n >= 0.3 THEN 'ar' ELSE 'en' END END AS script_language, lang AS declared FROM l
""")
def language_profile(spark, d):
    said = let(lg.counted(F.col("text")), lambda c: F.struct((c["arabic"] + c["latin"]).cast("int").alias("letters"), _r6(lg.share(c)).alias("arabic_share"), lg.verdict(c).alias("script_language")))
    return _docs(spark, d).select("doc_id", said.alias("s"), F.col("lang").alias("declared")).select("doc_id", F.col("s.letters").alias("letters"), F.col("s.arabic_share").alias("arabic_share"), F.col("s.script_language").alias("script_language"), "declared")


@_query(f"""
WITH l AS (SELECT doc_id, lang, {_count(_AR)} AS a, {_count(_AR)} + {_count(_LA)} AS n FROM documents)
SELECT doc_id, CASE WHEN n < 20 THEN lang WHEN a::DOUBLE / n >= 0.3 THEN 'ar' ELSE lang END AS language FROM l
""")
def resolve_language(spark, d):
    return _docs(spark, d).select("doc_id", lg.resolved(F.col("text"), F.col("lang"), F.lit("auto")).alias("language"))


@_query("""
WITH v(value) AS (SELECT DISTINCT lang FROM documents UNION ALL VALUES (' Arabic '), ('EN_us'), ('auto'), ('xx'), ('klingon'), ('farsi'), (''))
SELECT value, CASE value WHEN ' Arabic ' THEN 'ar' WHEN 'EN_us' THEN 'en' WHEN 'farsi' THEN 'fa' WHEN 'auto' THEN NULL WHEN '' THEN NULL WHEN 'klingon' THEN NULL ELSE value END AS code,
  CASE value WHEN ' Arabic ' THEN 'Arabic' WHEN 'EN_us' THEN 'English' WHEN 'farsi' THEN 'Persian' WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END AS name FROM v
""")
def language_names(spark, d):
    dirty = spark.createDataFrame([(v,) for v in (" Arabic ", "EN_us", "auto", "xx", "klingon", "farsi", "")], "value string")
    rows = _docs(spark, d).select(F.col("lang").alias("value")).distinct().union(dirty)
    return rows.select("value", lg.normalized(F.col("value")).alias("code"), lg.name_of(F.col("value")).alias("name"))


@_query(f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents)
SELECT doc_id, len(w)::INTEGER AS n_tokens, len(list_distinct(w))::INTEGER AS n_distinct, coalesce(list_max(list_transform(w, lambda x: length(x))), 0)::INTEGER AS longest FROM t
""")
def token_stats(spark, d):
    rows = _docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"), F.coalesce(F.array_max(F.transform("w", F.length)), F.lit(0)).alias("longest"))


@_query(f"""
WITH t AS (SELECT unnest({_TOKENS}) AS w FROM documents), f AS (SELECT regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS form FROM t)
SELECT form, count(*)::BIGINT AS n FROM f WHERE form <> '' GROUP BY form ORDER BY n DESC, form LIMIT 100
""")
def comparable_words_topk(spark, d):
    rows = _docs(spark, d).select(F.explode(tx.tokens(F.col("text"))).alias("w")).select(F.regexp_replace(F.lower("w"), r"[^\p{L}\p{N}]+", "").alias("form"))
    return rows.where("form <> ''").groupBy("form").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "form").limit(100)


@_query()
def folded_words(spark, d):
    return _docs(spark, d).select("doc_id", layout.fold_words("text").alias("w")).select("doc_id", F.size("w").alias("n_forms"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


_ENDS = r"""(regexp_matches(w, '[.!?\x{61f}\x{2026}]+["''\x{201d}\x{2019}\x{bb})\]]*$') AND NOT (
  regexp_matches(rtrim(w, '"''”’»)]'), '[^.]\.$|^\.$') AND (
    regexp_matches(replace(lower(rtrim(rtrim(w, '"''”’»)]'), '.')), '.', ''), '^(dr|mr|mrs|ms|prof|eg|ie|etc|vs|fig|eq|jr|sr|approx|dept)$')
    OR regexp_matches(rtrim(rtrim(w, '"''”’»)]'), '.'), '^\p{L}$'))))"""


@_query(f"""
WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents)
SELECT doc_id, count(*)::BIGINT AS n_tokens, count(*) FILTER (WHERE {_ENDS})::BIGINT AS n_ends FROM t GROUP BY doc_id
""")
def sentence_ends(spark, d):
    rows = _docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.filter("w", tx.ends_sentence)).cast("long").alias("n_ends"))


@_query(f"""
WITH a AS (SELECT doc_id, {_TOKENS} AS ws FROM documents), t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM a),
s AS (SELECT doc_id, pos, coalesce(sum(CASE WHEN {_ENDS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM t)
SELECT doc_id, sentence::BIGINT AS sentence, count(*)::BIGINT AS n_words, min(pos)::INTEGER AS first FROM s GROUP BY doc_id, sentence
""")
def sentences_flagged(spark, d):
    # Each answer depends on one row, so nothing is shuffled: places of sentence ends, then the spans between them.
    rows = _docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.transform(F.filter(F.transform("w", lambda x, i: F.when(tx.ends_sentence(x), i + 1)), lambda i: i < F.size("w")), lambda i: i)
    rows = rows.select("doc_id", F.size("w").alias("n"), F.concat(F.array(F.lit(0)), starts).alias("s"))
    spans = F.transform("s", lambda x, k: F.struct(k.cast("long").alias("sentence"), (F.coalesce(F.get("s", k + 1), F.col("n")) - x).cast("long").alias("n_words"), x.alias("first")))
    return rows.select("doc_id", F.inline(spans))


_SPANS = rf"""t AS (SELECT doc_id, {_TOKENS} AS ws FROM documents), f AS (
  SELECT doc_id, len(ws) AS n, list_transform(ws, lambda w, i: struct_pack(i := i::BIGINT, e := {_ENDS},
    s := regexp_matches(w, '[\x{{60c}}\x{{61b}};]+["''\x{{201d}}\x{{2019}}\x{{bb}})\]]*$'), k := regexp_matches(w, '[,:]+["''\x{{201d}}\x{{2019}}\x{{bb}})\]]*$'))) AS fs FROM t),
r AS (SELECT doc_id, n, list_reduce(list_transform(fs, lambda x: struct_pack(i := x.i, e := x.e, s := x.s, k := x.k, st := 0::BIGINT, ms := 0::BIGINT, mk := 0::BIGINT, out := []::BIGINT[])), lambda a, x:
  struct_pack(i := x.i, e := false, s := false, k := false,
    st := CASE WHEN x.e THEN x.i WHEN x.i - a.st >= 40 THEN CASE WHEN (CASE WHEN x.s THEN x.i ELSE a.ms END) >= a.st + 8 THEN (CASE WHEN x.s THEN x.i ELSE a.ms END) WHEN (CASE WHEN x.k THEN x.i ELSE a.mk END) >= a.st + 8 THEN (CASE WHEN x.k THEN x.i ELSE a.mk END) ELSE x.i END ELSE a.st END,
    ms := CASE WHEN x.s THEN x.i ELSE a.ms END, mk := CASE WHEN x.k THEN x.i ELSE a.mk END,
    out := CASE WHEN x.e THEN list_append(a.out, x.i) WHEN x.i - a.st >= 40 THEN list_append(a.out, CASE WHEN (CASE WHEN x.s THEN x.i ELSE a.ms END) >= a.st + 8 THEN (CASE WHEN x.s THEN x.i ELSE a.ms END) WHEN (CASE WHEN x.k THEN x.i ELSE a.mk END) >= a.st + 8 THEN (CASE WHEN x.k THEN x.i ELSE a.mk END) ELSE x.i END) ELSE a.out END),
  struct_pack(i := 0::BIGINT, e := false, s := false, k := false, st := 0::BIGINT, ms := 0::BIGINT, mk := 0::BIGINT, out := []::BIGINT[])) AS z FROM f WHERE n > 0),
sp AS (SELECT doc_id, n, CASE WHEN z.st < n THEN list_append(z.out, n) ELSE z.out END AS ends FROM r)"""


@_query(f"""
WITH {_SPANS}
SELECT doc_id, len(ends)::INTEGER AS n_sentences, md5(array_to_string(ends, ',')) AS ends FROM sp
""")
def sentence_spans(spark, d):
    rows = _docs(spark, d).select("doc_id", layout.sentence_spans("text").alias("s")).where(F.size("s") > 0)
    return rows.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join(F.transform("s", lambda x: x["last"].cast("string")), ",").cast("binary")).alias("ends"))


@_query()
def paragraph_layout(spark, d):
    parts = _docs(spark, d).select("doc_id", F.posexplode(F.split(layout.paragraph_text("text"), "\n\n")).alias("paragraph", "p"))
    return parts.where("p <> ''").select("doc_id", "paragraph", tx.n_tokens(F.col("p")).alias("n_words"))


@_query("SELECT 0::BIGINT AS violations")
def paragraph_preserves_tokens(spark, d):
    rows = _docs(spark, d).select("text", layout.paragraph_text("text").alias("p"))
    parts = F.filter(F.split("p", "\n\n"), lambda x: tx.n_tokens(x) > 180)
    wrong = (F.array_join(tx.tokens(F.col("text")), " ") != F.array_join(tx.tokens(F.col("p")), " ")) | (F.size(parts) > 0)
    return rows.agg(F.count_if(wrong).alias("violations"))


@_query(f"""
WITH a AS (SELECT doc_id, {_TOKENS} AS ws FROM documents), t AS (SELECT doc_id, lower(unnest(ws)) AS w, generate_subscripts(ws, 1) AS pos FROM a),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, w ORDER BY pos) AS island FROM t)
SELECT doc_id, w AS word, min(pos)::INTEGER - 1 AS first, count(*)::BIGINT AS n FROM g GROUP BY doc_id, w, island HAVING count(*) >= 3
""")
def loop_runs_size1(spark, d):
    return _docs(spark, d).select("doc_id", F.inline(tx.word_runs(F.col("text"))))


@_query()
def collapse_loops_effect(spark, d):
    rows = _docs(spark, d).select("doc_id", tx.n_tokens(F.col("text")).alias("before"), layout.collapse_loops("text").alias("t"))
    return rows.select("doc_id", "before", tx.n_tokens(F.col("t")).alias("after"))


@_query()
def fast_format_stats(spark, d):
    rows = _docs(spark, d).select("doc_id", tx.n_tokens(F.col("text")).alias("before"), layout.format_text("text", "lang").alias("t"))
    return rows.select("doc_id", "before", tx.n_tokens(F.col("t")).alias("after"), F.size(F.split("t", "\n\n")).alias("n_paragraphs"), F.md5(F.col("t").cast("binary")).alias("digest"))


@_query()
def strip_stock_phrases(spark, d):
    return _docs(spark, d).select("doc_id", tx.n_tokens(layout.strip_stock_phrases("text")).alias("n_tokens"))


_KEY = r"trim(regexp_replace(lower(line), '[^\p{L}\p{N}_\x{600}-\x{6ff}]+', ' ', 'g'))"


@_query(rf"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, trim(unnest(ls)) AS line, generate_subscripts(ls, 1) AS n FROM a),
k AS (SELECT *, {_KEY} AS f FROM l WHERE line <> ''), k2 AS (SELECT *, CASE WHEN len(string_split(f, ' ')) >= 3 AND regexp_matches(f, '\p{{L}}') THEN f ELSE '' END AS key FROM k),
b AS (SELECT *, lag(key) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM k2)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE key <> '' AND key = before)::BIGINT AS n_dropped FROM b GROUP BY doc_id
""")
def adjacent_line_dedupe(spark, d):
    told = let(markdown.keyed_lines(F.col("text")), lambda own: F.struct(F.size(own).cast("long").alias("n"), F.size(markdown.without_adjacent(own)).cast("long").alias("k")))
    rows = _docs(spark, d).select("doc_id", F.explode(F.filter(F.array(told), lambda x: x["n"] > 0)).alias("t"))
    return rows.select("doc_id", F.col("t.n").alias("n_lines"), (F.col("t.n") - F.col("t.k")).alias("n_dropped"))


_SIDES = _WS.rstrip("+")
_TRIM = lambda x: f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"
_FORM = lambda x: rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\x{{600}}-\x{{6ff}}]+', ' ', 'g'))"
_UNIT_KEY = lambda x: rf"CASE WHEN len(string_split({_FORM(x)}, ' ')) >= 3 AND regexp_matches({_FORM(x)}, '\p{{L}}') THEN {_FORM(x)} ELSE '' END"
_KEPT = "list_filter({0}, lambda v, j: v.k = '' OR j = 1 OR v.k <> {0}[j - 1].k)"


@_query(rf"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}]'), lambda x, i: struct_pack(x := {_TRIM('x')}, i := i)), lambda u: u.x <> '') AS nb FROM documents),
k AS (SELECT doc_id, list_transform(nb, lambda u, j: struct_pack(x := u.x, b := u.i - j, k := {_UNIT_KEY('u.x')})) AS nb FROM l),
f AS (SELECT doc_id, {_KEPT.format('nb')} AS nb FROM k),
p AS (SELECT doc_id, list_transform(nb, lambda u: struct_pack(b := u.b, ps := list_transform(list_filter(list_transform(string_split(regexp_replace(u.x, '([.!?\x{{61f}}]){_WS}', '\1' || chr(1), 'g'), chr(1)), lambda q: {_TRIM('q')}), lambda q: q <> ''), lambda q: struct_pack(x := q, k := {_UNIT_KEY('q')})))) AS nb FROM f),
s AS (SELECT doc_id, list_transform(nb, lambda u: struct_pack(b := u.b, x := array_to_string(list_transform({_KEPT.format('u.ps')}, lambda q: q.x), ' '))) AS nb FROM p),
t AS (SELECT doc_id, array_to_string(list_transform(nb, lambda u, j: CASE WHEN j = 1 THEN '' WHEN u.b <> nb[j - 1].b THEN chr(10) || chr(10) ELSE chr(10) END || u.x), '') AS t FROM s)
SELECT doc_id, length(t)::INTEGER AS n_chars, md5(t) AS digest FROM t
""")
def adjacent_unit_dedupe(spark, d):
    return _docs(spark, d).select("doc_id", markdown.without_repeats(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


def _packed_sql(units: str, most: int, gap: int) -> str:
    return f"""WITH t AS (SELECT doc_id, {units} AS u FROM documents), l AS (SELECT doc_id, list_transform(u, lambda x: length(x)::BIGINT) AS u FROM t WHERE len(u) > 0),
r AS (SELECT doc_id, list_reduce(list_transform(u, lambda x: struct_pack(x := x, size := 0::BIGINT, n := 0::BIGINT, longest := 0::BIGINT)), lambda a, b: struct_pack(x := b.x,
  size := CASE WHEN a.n > 0 AND a.size + {gap} + b.x <= {most} THEN a.size + {gap} + b.x ELSE b.x END,
  n := CASE WHEN a.n > 0 AND a.size + {gap} + b.x <= {most} THEN a.n ELSE a.n + 1 END,
  longest := greatest(a.longest, CASE WHEN a.n > 0 AND a.size + {gap} + b.x <= {most} THEN a.size + {gap} + b.x ELSE b.x END)), struct_pack(x := 0::BIGINT, size := 0::BIGINT, n := 0::BIGINT, longest := 0::BIGINT)) AS z FROM l)
SELECT doc_id, z.n AS n_chunks, z.longest AS longest FROM r"""


def _packed(rows: DataFrame, units, most: int, gap: int) -> DataFrame:
    rows = rows.select("doc_id", units.alias("u")).where(F.size("u") > 0)
    return rows.select("doc_id", tx.packed(F.col("u"), most, gap).alias("z")).select("doc_id", "z.n", "z.longest").withColumnRenamed("n", "n_chunks")


@_query(_packed_sql(_TOKENS, 500, 1))
def chunk_pack_words(spark, d):
    return _packed(_docs(spark, d), tx.tokens(F.col("text")), 500, 1)


@_query(_packed_sql("list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')", 3000, 1))
def chunk_pack_lines(spark, d):
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return _packed(_docs(spark, d), lines, 3000, 1)


@_query()
def chunk_texts(spark, d):
    return layout.chunk_rows(_docs(spark, d), 500).select("doc_id", "chunk_no", F.length("text").alias("n_chars"), tx.n_tokens(F.col("text")).alias("n_words"))


_PAIRS = "p AS (SELECT conv_id, turn, text AS source, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS output FROM conversations), q AS (SELECT * FROM p WHERE output IS NOT NULL)"
_EDGE = "\"''.,;:!?()[]{}«»…،؛؟-"
_SOURCE_WORDS = f"len(list_filter({_TOKENS.replace('text', 'source')}, lambda w: list_position(['آه', 'اه', 'أه', 'إمم', 'امم', 'يعني', 'يعنى', 'um', 'uh', 'uhm', 'umm', 'erm', 'hmm'], lower(trim(w, '{_EDGE}'))) IS NULL))"
_BODY_WORDS = rf"""len(list_filter(string_split_regex(regexp_replace(array_to_string(list_filter(string_split(output, chr(10)), lambda x: NOT regexp_matches(x, '^\s{{0,3}}#{{1,6}}\s')), chr(10)),
  '(?m)^\s{{0,3}}(#{{1,6}}\s+|[-*+]\s+|\d+\.\s+|>\s+)|[*_`|]+', ' ', 'g'), '{_WS}'), lambda x: x <> ''))"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("source"), F.lead("text").over(w).alias("output"))
    return rows.where(F.col("output").isNotNull())


@_query(f"""
WITH {_PAIRS}, c AS (SELECT conv_id, turn, {_SOURCE_WORDS} AS s, {_BODY_WORDS} AS b FROM q)
SELECT conv_id, turn, s::INTEGER AS source_words, b::INTEGER AS body_words, round(CASE WHEN s > 0 THEN b::DOUBLE / s ELSE 1 END, 6) AS coverage FROM c
""")
def coverage_pairs(spark, d):
    s, o = F.col("source"), F.col("output")
    return _pairs(spark, d).select("conv_id", "turn", tx.source_words(s).alias("source_words"), tx.body_words(o).alias("body_words"), _r6(tx.coverage(s, o)).alias("coverage"))


@_query(f"""
WITH {_PAIRS}, c AS (SELECT *, {_SOURCE_WORDS} AS s, {_BODY_WORDS} AS b, {_count(_AR, "source")} AS sa, {_count(_AR, "source")} + {_count(_LA, "source")} AS sn, {_count(_AR, "output")} AS oa, {_count(_AR, "output")} + {_count(_LA, "output")} AS onn FROM q),
x AS (SELECT *, CASE WHEN sn > 0 THEN sa::DOUBLE / sn ELSE 0 END AS sr, CASE WHEN onn > 0 THEN oa::DOUBLE / onn ELSE 0 END AS orr FROM c),
v AS (SELECT CASE WHEN length(trim(output)) = 0 THEN 'failed' WHEN sn >= 20 AND ((sa >= 20 AND sr >= 0.1 AND orr < 0.6 * sr) OR (sr < 0.15 AND orr >= sr + 0.3)) THEN 'translated'
  WHEN s >= 10 AND b::DOUBLE / s < 0.85 THEN 'too_short' WHEN s >= 10 AND b::DOUBLE / s > 1.6 THEN 'too_long' END AS reason FROM x)
SELECT coalesce(reason, 'fine') AS reason, count(*)::BIGINT AS n FROM v GROUP BY 1
""")
def validate_pairs(spark, d):
    reason = tx.rejection(F.col("source"), F.col("output"), F.lit("en"))
    return _pairs(spark, d).select(F.coalesce(reason, F.lit("fine")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@_query()
def markdown_layout(spark, d):
    return _docs(spark, d).select("doc_id", markdown.tidy("text").alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@_query()
def unwrapped_answers(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.length(markdown.unwrap("output", "source")).alias("n_chars"))


@_query(r"""
WITH l AS (SELECT trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT CASE WHEN regexp_matches(line, '^#{1,6}\s') THEN 'heading' WHEN regexp_matches(line, '^[-*•]\s') THEN 'bullet' WHEN regexp_matches(line, '^\d{1,3}[.)]\s') THEN 'numbered' ELSE 'paragraph' END AS kind, count(*)::BIGINT AS n
FROM l WHERE line <> '' GROUP BY 1
""")
def block_kinds(spark, d):
    return markdown.line_rows(_docs(spark, d)).groupBy(markdown.kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@_query(r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, trim(unnest(ls)) AS line, generate_subscripts(ls, 1) AS n FROM a),
k AS (SELECT *, CASE WHEN line = '' THEN NULL WHEN regexp_matches(line, '^#{1,6}\s') THEN 'heading' WHEN regexp_matches(line, '^[-*•]\s') THEN 'bullet' WHEN regexp_matches(line, '^\d{1,3}[.)]\s') THEN 'numbered' ELSE 'paragraph' END AS kind FROM l),
b AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM k),
g AS (SELECT *, sum(CASE WHEN kind IS NOT NULL AND (kind = 'heading' OR before IS NULL OR kind <> before) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS block_no FROM b)
SELECT doc_id, block_no::BIGINT AS block_no, min(kind) AS kind, count(*)::BIGINT AS n_lines FROM g WHERE kind IS NOT NULL GROUP BY doc_id, block_no
""")
def markdown_blocks(spark, d):
    return markdown.blocks(_docs(spark, d)).drop("text")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.col("source").alias("lecture"), F.col("doc_id").alias("part_no"), "text", F.col("lang").alias("reported"), F.col("n_chars").alias("duration"))


@_query("SELECT source AS lecture, doc_id AS part_no, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS \"offset\" FROM documents")
def part_offsets(spark, d):
    return votes.offsets(_parts(spark, d)).select("lecture", "part_no", "offset")


# Loops and stock phrases are out of SQL's reach, so the two votes are held against a brute-force version in the tests.
@_query()
def lecture_vote(spark, d):
    return votes.majority(votes.votes(votes.probed(_parts(spark, d)), "probe"))


@_query()
def parts_to_redo(spark, d):
    cast = votes.votes(votes.probed(_parts(spark, d)), "probe").persist()  # a few numbers a part, read twice; rows lost are made again
    return votes.to_redo(cast, votes.majority(cast))


@_query("""
WITH c AS (SELECT source AS lecture, lang AS reported, count(*)::BIGINT AS n FROM documents WHERE trim(coalesce(text, '')) <> '' AND lang IS NOT NULL GROUP BY ALL)
SELECT lecture, reported, n FROM (SELECT *, row_number() OVER (PARTITION BY lecture ORDER BY n DESC, reported) AS r FROM c) x WHERE r = 1
""")
def reported_mode(spark, d):
    return votes.reported_mode(_parts(spark, d))


@_query("SELECT source AS lecture, length(string_agg(text, ' ' ORDER BY doc_id))::INTEGER AS n_chars, md5(string_agg(text, ' ' ORDER BY doc_id)) AS digest FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY source")
def lecture_concat(spark, d):
    return votes.concatenated(_parts(spark, d)).select("lecture", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


@_query("SELECT coalesce(event_type, 'unknown') AS status, count(*)::BIGINT AS n FROM events GROUP BY 1")
def status_counts(spark, d):
    return registry.status_counts(_events(spark, d).select(F.col("event_type").alias("status")))


@_query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS r FROM events) x WHERE r = 1")
def latest_per_key(spark, d):
    rows = _events(spark, d).select(F.col("user_id").alias("video_id"), F.lit("auto").alias("language"), F.col("event_type").alias("mode"), F.col("event_id").alias("job_id"), F.lit("completed").alias("status"), F.lit("v").alias("format_version"), F.col("ts").alias("finished_at"), "value")
    return registry.newest_reusable(rows, "v").select(F.col("video_id").alias("user_id"), F.col("mode").alias("event_type"), F.col("job_id").alias("event_id"), "value")


@_query("""
WITH a AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS active_job FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id)
SELECT e.event_id, a.active_job FROM events e JOIN a ON a.user_id = e.user_id WHERE e.event_type = 'purchase'
""")
def active_duplicates(spark, d):
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").otherwise("completed")
    rows = _events(spark, d).select(F.col("event_id").alias("job_id"), F.col("user_id").alias("video_id"), F.lit("auto").alias("language"), F.lit("fast").alias("mode"), status.alias("status"), F.col("ts").alias("submitted_at"), "event_type")
    requests = rows.where("event_type = 'purchase'").select(F.col("job_id").alias("event_id"), *registry.KEYS)
    return registry.first_active(rows, requests).select("event_id", "active_job")


@_query("""
WITH j AS (SELECT event_id AS job_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'completed' END AS status, ts FROM events)
SELECT job_id, ((SELECT count(*) FROM j WHERE status = 'running') + rank() OVER (ORDER BY ts) - 1)::BIGINT AS ahead FROM j WHERE status = 'queued'
""")
def queue_rank(spark, d):
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "queued").otherwise("completed")
    return registry.queue_rank(_events(spark, d).select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").alias("submitted_at")))


_K = "(props::JSON ->> '$.k')::BIGINT"


@_query(f"SELECT event_id, max({_K}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::INTEGER AS progress FROM events")
def running_progress(spark, d):
    rows = _events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return progress.monotone(rows, "user_id", ["ts", "event_id"], "k").select("event_id", "progress")


@_query("""
WITH b AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
g AS (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM event_type AND before IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b)
SELECT user_id, run::BIGINT AS run, min(event_type) AS stage, count(*)::BIGINT AS n, min(ts) AS started FROM g GROUP BY user_id, run
""")
def stage_islands(spark, d):
    rows = progress.stage_runs(_events(spark, d), "user_id", ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "run").agg(F.min("event_type").alias("stage"), F.count("*").alias("n"), F.min("ts").alias("started"))


@_query("""
WITH s AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'formatted' ELSE 'fast' END AS mode, value, row_number() OVER (PARTITION BY user_id % 2 ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase' AND value IS NOT NULL),
m AS (SELECT mode, sum(value ORDER BY r) / count(*) AS x FROM s WHERE r <= 8 GROUP BY mode)
SELECT mode, round(x, 6) AS mean_seconds, greatest(90, floor(x * CASE mode WHEN 'formatted' THEN 0.65::DOUBLE ELSE 0.8::DOUBLE END))::BIGINT AS transcribing, greatest(60, floor(x * 0.3::DOUBLE))::BIGINT AS formatting, greatest(20, floor(x * 0.1::DOUBLE))::BIGINT AS downloading FROM m
""")
def eta_last8(spark, d):
    rows = _events(spark, d).where("event_type = 'purchase'")
    rows = rows.select(F.when(F.col("user_id") % 2 == 0, "formatted").otherwise("fast").alias("mode"), F.lit("completed").alias("status"), F.col("value").alias("seconds"), F.col("ts").alias("submitted_at"), F.col("event_id").alias("job_id"))
    return registry.recent_mean(rows).withColumn("mean_seconds", _r6(F.col("mean_seconds")))


@_query("""
WITH f AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('purchase', 'click'))
SELECT e.event_id AS job_id FROM events e LEFT JOIN f USING (event_id) WHERE f.r IS NULL OR f.r <= 500
""")
def trim_history(spark, d):
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "failed").otherwise("running")
    rows = _events(spark, d).select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").alias("finished_at"), F.col("ts").alias("submitted_at"), F.lit(False).alias("notices"))
    return registry.trimmed(rows).select("job_id")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("client"), _micros("ts").alias("at"))


@_query("SELECT event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)::BIGINT AS offered FROM events")
def rate_offered(spark, d):
    return limits.offered(_log(spark, d), 86_400).select("id", "offered")


_ADMIT = """WITH l AS (SELECT user_id, list(struct_pack(id := event_id, at := epoch_us(ts)) ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
r AS (SELECT user_id, list_reduce(list_transform(l, lambda x: struct_pack(id := x.id, at := x.at, log := []::BIGINT[], out := []::STRUCT(id BIGINT, ok BOOLEAN, retry BIGINT)[])), lambda a, x: struct_pack(id := x.id, at := x.at,
  log := CASE WHEN len(list_filter(a.log, lambda t: t > x.at - 86400000000)) < 2 THEN list_append(list_filter(a.log, lambda t: t > x.at - 86400000000), x.at) ELSE list_filter(a.log, lambda t: t > x.at - 86400000000) END,
  out := list_append(a.out, struct_pack(id := x.id, ok := len(list_filter(a.log, lambda t: t > x.at - 86400000000)) < 2,
    retry := CASE WHEN len(list_filter(a.log, lambda t: t > x.at - 86400000000)) < 2 THEN NULL ELSE greatest(1, ceil((list_filter(a.log, lambda t: t > x.at - 86400000000)[1] + 86400000000 - x.at) / 1000000.0))::BIGINT END))),
  struct_pack(id := 0::BIGINT, at := 0::BIGINT, log := []::BIGINT[], out := []::STRUCT(id BIGINT, ok BOOLEAN, retry BIGINT)[])) AS z FROM l), u AS (SELECT unnest(z.out) AS o FROM r)
"""


@_query(_ADMIT + "SELECT o.id AS id, o.ok AS admitted FROM u")
def rate_admitted(spark, d):
    return limits.admitted(_log(spark, d), 2, 86_400).select("id", "admitted")


@_query(_ADMIT + "SELECT o.id AS id, o.retry AS retry_after FROM u WHERE NOT o.ok")
def retry_after(spark, d):
    return limits.admitted(_log(spark, d), 2, 86_400).where("NOT admitted").select("id", "retry_after")


@_query("""
WITH b AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS before FROM events), s AS (SELECT ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 900 SECOND THEN 1 ELSE 0 END) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM b)
SELECT session::BIGINT AS session, epoch_us(min(ts)) AS begin, epoch_us(max(ts)) AS finish, count(*)::BIGINT AS n FROM s GROUP BY session
""")
def keepalive_sessions(spark, d):
    return limits.sessions(_events(spark, d).select(_micros("ts").alias("at")))


@_query("SELECT event_id AS job_id, event_type AS status FROM events WHERE event_type = 'view' AND contains(lower(event_id::VARCHAR || ' ' || event_type || ' ' || props), '7}')")
def history_search(spark, d):
    rows = _events(spark, d).select(F.col("event_id").alias("job_id"), F.col("event_type").alias("title"), F.col("props").alias("url"), F.col("event_type").alias("status"), _micros("ts").alias("submitted_at"))
    return registry.search(rows, "7}", "view").select("job_id", "status")


_ERRORS = ("OSError: Read-only file system", "DownloadError: HTTP Error 403: Forbidden", "X: Sign in to confirm you're not a bot", "X: Private video", "X: This is members-only", "X: age-restricted", "X: ffprobe missing", "RuntimeError: CUDA out of memory", "ValueError: other")


@_query("WITH e(error, hint) AS (VALUES " + ", ".join("('" + e.replace("'", "''") + "', " + ("NULL" if i == 8 else "'" + registry.ERROR_RULES[i][1] + "'") + ")" for i, e in enumerate(_ERRORS)) + ") SELECT error, CASE WHEN hint IS NULL THEN error ELSE hint || ' (' || error || ')' END AS message FROM e")
def error_hints(spark, d):
    return spark.createDataFrame([(e,) for e in _ERRORS], "error string").select("error", registry.described(F.col("error")).alias("message"))


@_query(r"""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\.', '') AS host, trim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS path, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme FROM pages
""")
def url_canonical(spark, d):
    return _table(spark, d, "pages").select("page_id", urls.parts(F.col("url")).alias("p")).select("page_id", "p.host", "p.path", "p.scheme")


_VIDEOS = (
    ("https://www.youtube.com/watch?v=dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("youtu.be/dQw4w9WgXcQ?t=3", "dQw4w9WgXcQ"), ("https://m.youtube.com/shorts/dQw4w9WgXcQ", "dQw4w9WgXcQ"),
    ("https://music.youtube.com/live/dQw4w9WgXcQ/x", "dQw4w9WgXcQ"), ("https://youtube.com:443/watch?v=dQw4w9WgXcQ", None), ("https://youtube.com/watch?v=&v=dQw4w9WgXcQ", "dQw4w9WgXcQ"),
    ("https://youtube.com/watch?v=short", None), ("https://youtube.com/watch?v=dQw4 w9WgXcQ", None), ("ftp://youtube.com/watch?v=dQw4w9WgXcQ", None), (" ", None), ("https://example.org/watch?v=dQw4w9WgXcQ", None),
)


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{u}', {'NULL' if v is None else repr(v)})" for u, v in _VIDEOS) + ") t(url, video_id)")
def video_ids(spark, d):
    return spark.createDataFrame([(u,) for u, _ in _VIDEOS], "url string").select("url", urls.video_id(F.col("url")).alias("video_id"))


@_query(r"""
WITH n AS (SELECT page_id, trim(regexp_replace(regexp_replace(trim(url), '[<>:"/\\|?*\n\r\t]+', '_', 'g'), '\s+', ' ', 'g'), ' .') AS name FROM pages)
SELECT page_id, coalesce(nullif(rtrim(substr(name, 1, 150), ' .'), ''), 'lecture') AS name FROM n
""")
def safe_filenames(spark, d):
    return _table(spark, d, "pages").select("page_id", urls.file_name(F.col("url")).alias("name"))


_ENTRY = "epoch_us(min(ts)) AS created_at, epoch_us(max(ts)) AS updated_at, max(value) AS value"
_LATE = "coalesce(ts >= (SELECT date_trunc('day', max(ts)) FROM events), false)"
_SLICES = f"o AS (SELECT user_id, {_ENTRY} FROM events WHERE NOT {_LATE} GROUP BY user_id), w AS (SELECT user_id, {_ENTRY} FROM events WHERE {_LATE} GROUP BY user_id)"


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    """user_id, created_at, updated_at, value of all events before the last one's day (or at no known time), and of all events of that day."""
    rows = _events(spark, d)
    last = rows.agg(F.date_trunc("day", F.max("ts")).alias("last"))
    rows = rows.crossJoin(F.broadcast(last))  # one row
    late = F.coalesce(F.col("ts") >= F.col("last"), F.lit(False))
    entries = lambda x: x.groupBy("user_id").agg(F.min(_micros("ts")).alias("created_at"), F.max(_micros("ts")).alias("updated_at"), F.max("value").alias("value"))
    return entries(rows.where(~late)), entries(rows.where(late))


@_query(f"WITH {_SLICES} SELECT coalesce(o.user_id, w.user_id) AS user_id, coalesce(o.created_at, w.created_at) AS created_at, coalesce(w.updated_at, o.updated_at) AS updated_at, coalesce(w.value, o.value) AS value FROM o FULL JOIN w ON o.user_id IS NOT DISTINCT FROM w.user_id")
def cache_upsert(spark, d):
    return registry.upserted(*_halves(spark, d), "user_id")


@_query(f"WITH {_SLICES} SELECT user_id FROM o WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = o.user_id)")
def cache_stale(spark, d):
    old, new = _halves(spark, d)
    paths = {"raw_path": F.concat(F.col("user_id").cast("string"), F.lit(".txt")), "cleaned_path": F.concat(F.col("user_id").cast("string"), F.lit(".md"))}
    old = old.select("user_id", F.lit("v").alias("format_version"), *(p.alias(c) for c, p in paths.items()))
    files = new.select(F.explode(F.array(*paths.values())).alias("path"))
    return registry.stale(old, "v", files).select("user_id")


@_query("SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN k > 0 THEN 35 + floor(greatest(0, least(1, (k - 1)::DOUBLE / 10)) * 35) ELSE 35 END WHEN 'view' THEN 72 + floor(greatest(0, least(1, k::DOUBLE / 10)) * 22) ELSE 0 END::INTEGER AS percent FROM (SELECT *, " + _K + " AS k FROM events) e")
def stage_percent(spark, d):
    stage = F.when(F.col("event_type") == "click", "transcribing").when(F.col("event_type") == "view", "formatting").otherwise("queued")
    rows = _events(spark, d).select("event_id", stage.alias("stage"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.select("event_id", progress.percent(F.col("stage"), F.col("k"), F.lit(10)).alias("percent"))
