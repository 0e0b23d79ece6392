"""Evidence entries, names, citations, labels and dates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.functions import evidence as E
from curalake.functions import sentinel as S
from curalake.functions import text as T
from curalake.functions import wording as W
from curalake.plans.registry import query, read


def _joined(c, separator: str = "|"):
    return F.array_join(c, separator)


#: The distinct values of a list in the order of their first places, in DuckDB.
_FIRSTS = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"

_CELL = "CASE p_partkey % 6 WHEN 0 THEN '• ' || p_name WHEN 1 THEN ' NA' WHEN 2 THEN '- ' || p_brand WHEN 3 THEN '' WHEN 4 THEN p_type ELSE NULL END"


@query(rf"SELECT p_partkey, CASE WHEN upper(trim(c)) NOT IN ('', 'NA', 'N/A') THEN regexp_replace(trim(c), '^[•*·-]\s+', '') END AS cell FROM (SELECT p_partkey, {_CELL} AS c FROM part)")
def cleaned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing words as null, bullets cut."""
    c = F.expr(_CELL)
    return read(spark, sf_dir, "part").select("p_partkey", W.strip_bullets(W.missing_to_null(c, ("NA", "N/A"))).alias("cell"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '^\s+|\s+$', '', 'g'))) AS clean FROM (SELECT doc_id, replace(text, chr(160), ' ') AS text FROM documents WHERE text IS NOT NULL)""")
def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks and line ends normalised."""
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(T.clean_text(F.col("text")).cast("binary")).alias("clean"))


_NAMES = "split(lower(p_type) || ',' || p_name || ', ' || p_name || ',' || lower(p_brand), ',')"
_NAMES_SQL = "list_transform(string_split(lower(p_type) || ',' || p_name || ', ' || p_name || ',' || lower(p_brand), ','), lambda x: trim(x))"


@query(f"""WITH a AS (SELECT p_partkey, list_transform({_NAMES_SQL}, lambda x: replace(replace(x, 'small', 'tiny'), 'widget', 'gear')) AS w, list_transform({_NAMES_SQL}, lambda x: CASE x WHEN 'brand#2' THEN 'second' WHEN 'economy' THEN 'cheap' ELSE x END) AS f FROM part)
    SELECT p_partkey, array_to_string({_FIRSTS.format('w')}, '|') AS rewritten, array_to_string(list_filter({_FIRSTS.format('f')}, lambda x: x IN ('second', 'cheap', 'small ring', 'promo')), '|') AS folded FROM a""")
def folded_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms inside traits, and whole traits by their key; tracked ones only."""
    names = F.expr(_NAMES)
    rewritten = E.rewritten(names, [("small", "tiny"), ("widget", "gear")])
    folded = E.folded(names, {"Brand#2": "second", "ECONOMY": "cheap"}, ["second", "cheap", "small ring", "promo"])
    return read(spark, sf_dir, "part").select("p_partkey", _joined(rewritten).alias("rewritten"), _joined(folded).alias("folded"))


_ENTRY = "CASE p_partkey % 6 WHEN 0 THEN 'eQTL (' || p_name || ')' WHEN 1 THEN 'pqtl: ' || p_brand WHEN 2 THEN 'TWAS' WHEN 3 THEN 'eQTL (' || p_name || ' (' || p_size || ')' WHEN 4 THEN 'other ' || p_name ELSE 'pQTL  ' || p_name END"
_TYPES = ["eQTL", "pQTL", "TWAS"]
#: An entry of a known type as it is, one that a known type leads as `Type (detail)`, else null.
_GATE = r"""CASE WHEN trim(split_part({0}, '(', 1)) IN ('eQTL', 'pQTL', 'TWAS') THEN trim({0}) WHEN regexp_matches({0}, '(?i)^\s*(eqtl|pqtl|twas)\b') THEN
    CASE lower(regexp_extract({0}, '(?i)^\s*(eqtl|pqtl|twas)\b', 1)) WHEN 'eqtl' THEN 'eQTL' WHEN 'pqtl' THEN 'pQTL' ELSE 'TWAS' END || coalesce(' (' || nullif(trim(regexp_extract({0}, '(?i)^\s*(?:eqtl|pqtl|twas)\b[\s:;,-]*(.*)$', 1)), '') || ')', '') END"""


@query(rf"""WITH a AS (SELECT p_partkey, {_ENTRY} AS e FROM part)
    SELECT p_partkey, trim(split_part(e, '(', 1)) AS type, nullif(trim(regexp_extract(e, '^[^(]*\((.*)\)\s*$', 1)), '') AS detail, {_GATE.format("e")} AS gated,
    CASE lower(trim(split_part(e, '(', 1))) WHEN 'eqtl' THEN 'expression' || coalesce(' (' || nullif(trim(regexp_extract(e, '^[^(]*\((.*)\)\s*$', 1)), '') || CASE WHEN p_partkey % 6 = 3 THEN ')' ELSE '' END || ')', '') WHEN 'twas' THEN 'transcriptome' ELSE '' END AS coerced FROM a""")
def evidence_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries parsed, gated by their type, and coerced to known spellings with balanced parentheses."""
    e = F.expr(_ENTRY)
    coerced = E.coerced(F.array(e), {"EQTL": "expression", "twas": "transcriptome"})
    return read(spark, sf_dir, "part").select("p_partkey", E.parse(e)["type"].alias("type"), E.parse(e)["detail"].alias("detail"), F.try_element_at(E.publishable(F.array(e), _TYPES), F.lit(1)).alias("gated"), _joined(coerced).alias("coerced"))


_EVIDENCE = "CASE WHEN p_partkey % 9 <> 0 THEN 'eQTL (' || p_name || ', ' || p_brand || ');  pQTL ' || p_size || ', eQTL (' || p_name || ', ' || p_brand || '), junk' END"


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN 'eQTL (' || p_name || ', ' || p_brand || ')|pQTL (' || p_size || ')' ELSE '' END AS entries FROM part")
def evidence_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells split outside parentheses, gated and made distinct."""
    return read(spark, sf_dir, "part").select("p_partkey", _joined(E.evidence_cell(F.expr(_EVIDENCE), _TYPES)).alias("entries"))


_STEM = "upper(left(p_name, 1)) || substr(p_name, 2)"


@query(f"SELECT p_partkey, {_STEM} || ' X' AS stem FROM part")
def trade_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without the code behind them."""
    return read(spark, sf_dir, "part").select("p_partkey", E.trade_stem(F.expr(f"{_STEM} || ' X AB-' || p_size")).alias("stem"))


@query("""SELECT p_partkey, regexp_matches(p_name, '(?i)\\bring\\b') OR p_partkey % 4 = 0 AS comparator FROM part""")
def comparators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """by the name, or by a synonym."""
    name = F.regexp_replace("p_name", r"\bring\b", "Placebo")
    synonyms = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("x"), F.lit("normal saline")))
    return read(spark, sf_dir, "part").select("p_partkey", E.is_comparator(name, synonyms).alias("comparator"))


_REGISTRY = "CASE s_suppkey % 4 WHEN 0 THEN 'NCT0000' || s_suppkey WHEN 1 THEN 'jRCT ' || s_suppkey WHEN 2 THEN s_name ELSE NULL END"


@query(f"""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'ClinicalTrials.gov' WHEN 1 THEN 'Japan' END AS registry, CASE s_suppkey % 4 WHEN 0 THEN 'https://clinicaltrials.gov/study/NCT0000' || s_suppkey WHEN 1 THEN 'https://jrct.mhlw.go.jp/?id=jRCT+' || s_suppkey END AS link FROM supplier""")
def registry_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X23."""
    c = F.expr(_REGISTRY)
    names, links = {"NCT": "ClinicalTrials.gov", "JRCT": "Japan"}, {"NCT": "https://clinicaltrials.gov/study/{}", "JRCT": "https://jrct.mhlw.go.jp/?id={}"}
    return read(spark, sf_dir, "supplier").select("s_suppkey", W.registry(c, names).alias("registry"), W.registry_link(c, links).alias("link"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'I/II' WHEN 1 THEN 'III' WHEN 2 THEN NULL ELSE 'II' END AS phase, CASE o_orderstatus WHEN 'F' THEN 'Industry' WHEN 'O' THEN 'NIH' ELSE 'Other' END AS sponsor FROM orders""")
def phase_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X24, X25."""
    codes = F.expr("CASE o_orderkey % 4 WHEN 0 THEN array('PHASE1', 'PHASE2') WHEN 1 THEN array('PHASE3') WHEN 2 THEN array('NA') ELSE array('X', 'PHASE2') END")
    return read(spark, sf_dir, "orders").select("o_orderkey", W.phase_label(codes, {"PHASE1": "I", "PHASE2": "II", "PHASE3": "III"}).alias("phase"), W.sponsor_class(F.lower("o_orderstatus"), {"F": "Industry", "O": "NIH"}, "Other").alias("sponsor"))


@query(r"SELECT 'c' AS of, conv_id AS id, turn AS n, md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS folded FROM conversations UNION ALL SELECT 'd', doc_id, NULL, md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) FROM documents")
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of conversations and documents without their marks."""
    texts = read(spark, sf_dir, "conversations").select(F.lit("c").alias("of"), F.col("conv_id").alias("id"), F.col("turn").alias("n"), "text")
    texts = texts.unionByName(read(spark, sf_dir, "documents").select(F.lit("d").alias("of"), F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("n"), "text"))
    return texts.select("of", "id", "n", F.md5(T.fold_accents(F.col("text")).cast("binary")).alias("folded"))


_WORDING = "upper(p_type) || ' uses AB and ABC of ' || p_brand || ' in XAB, QZ ' || CASE WHEN p_partkey % 2 = 0 THEN 'AB' ELSE 'TWAS' END"


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'AB|ABC' ELSE 'AB|ABC|TWAS' END AS found, upper(p_type) || '|XAB|QZ' AS rest FROM part""")
def acronym_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known acronyms of a text, and capitals that none covers."""
    known = ["AB", "ABC", "TWAS"]
    return read(spark, sf_dir, "part").select("p_partkey", _joined(E.acronyms(F.expr(_WORDING), known)).alias("found"), _joined(E.uncovered(F.expr(_WORDING), known)).alias("rest"))


@query("SELECT p_partkey, p_type || '|' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '|' || p_name ELSE '' END AS steps, p_name || ' (x)' AS name, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS \"group\" FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, p_type || '|' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '|' || p_name ELSE '' END, p_name, NULL FROM part WHERE p_partkey % 3 = 0")
def chained_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a chain, and a name with its trailing group."""
    chain = F.expr("p_type || ' >> ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' < ' || p_name ELSE ' >' END")
    cell = E.trailing_group(F.expr("CASE WHEN p_partkey % 3 > 0 THEN p_name || ' (x) (' || p_brand || ')' ELSE p_name END"))
    return read(spark, sf_dir, "part").select("p_partkey", _joined(E.chain(chain)).alias("steps"), cell["name"].alias("name"), cell["group"].alias("group"))


_WORDS_SQL = r"' ' || trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


@query(rf"""WITH a AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'no such words' ELSE array_to_string(list_slice(string_split(text, ' '), 3, 6), chr(10) || ' ') END AS quote FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, {_WORDS_SQL.format("text")} AS t, {_WORDS_SQL.format("quote")} AS q FROM a)
    SELECT doc_id, CAST(CASE WHEN trim(q) = '' THEN 0 ELSE strpos(t, q) END AS INTEGER) AS at FROM b""")
def quote_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether and where a quote stands in its text."""
    quote = F.when(F.col("doc_id") % 3 == 0, "no such words").otherwise(F.array_join(F.slice(F.split("text", " "), 3, 4), "\n "))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", W.located(F.col("text"), quote).alias("at"))


_ERROR = "CASE event_id % 4 WHEN 0 THEN 'HTTP 429 from https://api.example.org/a/b?x=1' WHEN 1 THEN 'timeout reading /var/lib/x.txt' WHEN 2 THEN 'bad key abcdefghijklmnopqrstuvwxyz012345' ELSE 'odd value ' || event_type END"


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'HTTP 429 from <url>' WHEN 1 THEN 'timeout reading <path>' WHEN 2 THEN 'bad key <redacted>' ELSE 'odd value ' || event_type END AS message,
    CASE event_id % 4 WHEN 0 THEN 'rate limit' WHEN 1 THEN 'timeout' ELSE 'other' END AS kind FROM events""")
def published_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors without secrets, and their kind."""
    c = F.expr(_ERROR)
    return read(spark, sf_dir, "events").select("event_id", T.publishable_error(c).alias("message"), W.error_kind(c, {"rate limit": "429", "timeout": "(?i)time.?out"}, "other").alias("kind"))


@query("""WITH a AS (SELECT doc_id, text, CAST(floor(length(text) / 2) AS INTEGER) AS half FROM documents WHERE text IS NOT NULL), b AS (SELECT *, strpos(substr(text, half + 1), ' the ') AS found FROM a)
    SELECT doc_id, CAST(length(CASE WHEN found > 0 THEN substr(text, 1, half + found - 1) ELSE text END) AS INTEGER) AS kept FROM b""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut at a heading in the latter half."""
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length(W.without_back_matter(F.col("text"), " the ")).alias("kept"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', b / 1024) || ' KB' ELSE printf('%.1f', b / 1048576) || ' MB' END AS bytes,
    CASE WHEN l_linenumber = 0 THEN '0%' WHEN l_linenumber >= 7 THEN '100%' ELSE CAST(greatest(1, least(99, round(100 * l_linenumber / 7))) AS INTEGER) || '%' END AS share, l_linenumber || CASE l_linenumber WHEN 1 THEN ' line' ELSE ' lines' END AS counted,
    CASE WHEN l_linenumber < 7 THEN 'first ' || l_linenumber || ' of 7' END AS note FROM (SELECT *, 2 * CAST(l_quantity * l_quantity * l_partkey AS BIGINT) + 1 AS b FROM lineitem WHERE l_linenumber <= 7)""")
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, shares, counts and truncation in words."""
    size, n = 2 * (F.col("l_quantity") * F.col("l_quantity") * F.col("l_partkey")).cast("long") + 1, F.col("l_linenumber")  # odd, so no midpoints
    df = read(spark, sf_dir, "lineitem").where("l_linenumber <= 7")
    return df.select("l_orderkey", "l_linenumber", W.bytes_label(size).alias("bytes"), W.percent_label(n, F.lit(7)).alias("share"), W.counted(n, "line").alias("counted"), W.truncation_note(n, F.lit(7)).alias("note"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS took FROM (SELECT event_id, CAST(floor(value * value) AS BIGINT) AS s FROM events)""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations in words."""
    return read(spark, sf_dir, "events").select("event_id", T.duration_label(F.col("value") * F.col("value")).alias("took"))


@query("""WITH a AS (SELECT r_regionkey, r_name, list(n_name ORDER BY n_nationkey) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL), b AS (SELECT r_name, '(' || array_to_string(list_transform(names, lambda x: '"' || x || '"[Title]'), ' OR ') || ') AND english[lang]' AS query FROM a)
    SELECT r_name, query, sha256(query) AS version FROM b""")
def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disjunction of terms for each region, and its digest."""
    nations = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    text = W.query_text(F.col("names"), "Title", "english[lang]")
    return read(spark, sf_dir, "region").join(nations, "r_regionkey").select("r_name", text.alias("query"), F.sha2(text.cast("binary"), 256).alias("version"))


@query(r"""WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'blank' END, CASE WHEN text <> regexp_replace(text, '^\s+|\s+$', '', 'g') THEN 'edge blanks' END, CASE WHEN contains(text, '  ') THEN 'double blank' END,
    CASE WHEN regexp_matches(text, '[\x00-\x08\x0e-\x1f]') THEN 'control character' END, CASE WHEN regexp_matches(text, '[^\x00-\x7f]') THEN 'not ASCII' END, CASE WHEN NOT regexp_matches(text, '[A-Za-z]') THEN 'no letter' END], lambda x: x IS NOT NULL), ',') AS issues FROM a""")
def field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a field that its text breaks."""
    return read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", _joined(W.field_issues(F.col("text")), ",").alias("issues"))


@query("""SELECT o_orderkey, month(o_orderdate) || '/' || year(o_orderdate) || CASE WHEN o_orderkey % 3 = 0 THEN ' (' || o_orderpriority || ')' ELSE '' END AS noted, strftime(o_orderdate, '%b %Y') AS short, strftime(o_orderdate, '%-d %B %Y') AS long, strftime(o_orderdate, '%Y-%m') AS month,
    round_even(o_orderkey / 7.0, 1) AS one, round_even(o_orderkey / 7.0, 3) AS three FROM orders""")
def display_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with notes, dates in words, month precision and rounding."""
    noted = W.noted_month(F.date_format("o_orderdate", "yyyy-MM"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")))
    month = T.to_month(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read(spark, sf_dir, "orders").select("o_orderkey", noted.alias("noted"), F.date_format("o_orderdate", "MMM yyyy").alias("short"), F.date_format("o_orderdate", "d MMMM yyyy").alias("long"), month.alias("month"), F.bround(F.col("o_orderkey") / 7.0, 1).alias("one"), F.bround(F.col("o_orderkey") / 7.0, 3).alias("three"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'L' ELSE '' END || CASE WHEN p_retailprice > 1000 THEN 'P' ELSE '' END || CASE WHEN p_type = 'PROMO' THEN 'M' ELSE '' END AS glyphs, CASE p_type WHEN 'PROMO' THEN 'red' WHEN 'ECONOMY' THEN 'blue' ELSE 'grey' END AS colour,
    upper(p_type) IN ('PROMO', 'Y') AS flag, p_partkey % 3 AS span FROM part""")
def part_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks that hold, a lookup with a default, a text as boolean, the largest span of pairs."""
    marks = F.filter(F.array(F.when(F.col("p_size") > 40, "L"), F.when(F.col("p_retailprice") > 1000, "P"), F.when(F.col("p_type") == "PROMO", "M")), lambda x: x.isNotNull())
    pairs = F.array(F.struct(F.lit("5").alias("start"), (5 + F.col("p_partkey") % 3).cast("string").alias("stop")), F.struct(F.lit("x").alias("start"), F.lit("9").alias("stop")))
    span = F.coalesce(F.array_max(F.transform(pairs, lambda x: F.abs(x["stop"].try_cast("long") - x["start"].try_cast("long")))), F.lit(0))
    flag = S.to_boolean(F.when(F.col("p_type") == "PROMO", "yes").otherwise(F.col("p_type")))
    return read(spark, sf_dir, "part").select("p_partkey", _joined(marks, "").alias("glyphs"), E.lookup(F.col("p_type"), {"PROMO": "red", "economy": "blue"}, F.lit("grey")).alias("colour"), flag.alias("flag"), span.alias("span"))


@query("""WITH a AS (SELECT p_partkey, p_type || (p_partkey % 13) AS label FROM part) SELECT p_partkey, label, row_number() OVER (ORDER BY lower(regexp_extract(label, '^\\D+')), CAST(regexp_extract(label, '\\d+') AS INTEGER), p_partkey) AS place FROM a""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with numbers in the order of the numbers, whatever the case."""
    from curalake.operators import ordering

    label = F.concat("p_type", (F.col("p_partkey") % 13).cast("string"))
    df = read(spark, sf_dir, "part").select("p_partkey", label.alias("label")).withColumn("key", T.natural_key(F.col("label")))
    return ordering.numbered(df, ["key", "p_partkey"], "place").select("p_partkey", "label", "place")
