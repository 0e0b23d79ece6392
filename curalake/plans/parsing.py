"""Text parsers over documents, pages and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.functions import text as T
from curalake.plans.registry import query, read


@query(r"""SELECT url_template, count(*) AS n FROM (SELECT '/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(url, '^https?://[^/]*', ''), '/'), lambda x: x <> ''),
    lambda x: CASE WHEN regexp_matches(x, '[0-9]') AND NOT regexp_full_match(x, 'v[0-9]+') THEN ':id' ELSE x END), '/') AS url_template FROM pages) GROUP BY 1""")
def url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X35."""
    path = F.regexp_replace("url", r"^https?://[^/]*", "")
    return read(spark, sf_dir, "pages").select(T.path_template(path).alias("url_template")).groupBy("url_template").agg(F.count("*").alias("n"))


@query()
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page, and how much of the markup that is. The pattern looks back, so there is no SQL; a test holds it against a parser."""
    text = T.plain_html(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", text.alias("plain"), F.length("html").cast("long").alias("html_chars"), F.length(text).cast("long").alias("text_chars"))


@query(r"SELECT doc_id, array_to_string(list_distinct(n), ',') AS numbers, len(n) AS found FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{5,}') AS n FROM documents)".replace("array_to_string(list_distinct(n), ',')", "array_to_string(list_sort(list_distinct(n)), ',')").replace("len(n) AS found", "CAST(len(n) AS INTEGER) AS found"))
def long_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10."""
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.distinct_matches(F.col("text"), "[0-9]{5,}")), ",").alias("numbers"), F.size(F.regexp_extract_all("text", F.lit("[0-9]{5,}"), F.lit(0))).alias("found"))


_CELL = """CASE p_partkey % 6 WHEN 0 THEN (p_partkey + 1) || ', ' || (p_size + 4000) WHEN 1 THEN 'PMID: ' || (p_partkey + 1) || ' and ' || (10000000 + p_partkey) WHEN 2 THEN 'see 10.1000/' || (10000000 + p_partkey) || ' in 1999'
    WHEN 3 THEN (p_size + 1) || ',606,365 of ' || p_name WHEN 4 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || (p_partkey + 1) || '/ ' || (7000000 + p_partkey) ELSE 'in ' || p_size || ' of ' || p_name END"""


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN (p_partkey + 1) || CASE WHEN p_partkey + 1 = p_size + 4000 THEN '' ELSE ',' || (p_size + 4000) END WHEN 1 THEN (p_partkey + 1) || ',' || (10000000 + p_partkey) WHEN 4 THEN (p_partkey + 1) || ',' || (7000000 + p_partkey) ELSE '' END AS ids FROM part""")
def article_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of numbers, labelled and linked ids, DOIs, numbers with thousands separators, short numbers in prose."""
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(T.pmids(F.expr(_CELL)), ",").alias("ids"))


_TARGETS = "CASE p_partkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN 'COL' || p_size || 'A1/' || (p_size + 2) || '; APP' || p_partkey WHEN 2 THEN p_type || ' disease: ' || upper(p_name) || ', ' || p_name WHEN 3 THEN upper(p_type) || ':CTB-1 / APOE; APOE' ELSE NULL END"


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'COL' || p_size || 'A1|COL' || p_size || 'A' || (p_size + 2) || '|APP' || p_partkey WHEN 2 THEN upper(p_name) || '|' || p_name WHEN 3 THEN upper(p_type) || ':CTB-1|APOE' ELSE '' END AS targets FROM part")
def target_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: nothing, pairs in shorthand, labels before symbols, other case, repeats."""
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(T.targets(F.expr(_TARGETS)), "|").alias("targets"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' (' || p_brand || ', c)|' || p_type WHEN 1 THEN p_type || ' ((' || p_size || ', z), w)|' || p_name ELSE p_name END AS parts FROM part")
def top_level_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X16."""
    c = F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name || ' (' || p_brand || ', c), ' || p_type WHEN 1 THEN p_type || ' ((' || p_size || ', z), w) , ' || p_name ELSE p_name END")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(T.split_top_level(c), "|").alias("parts"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'MONDO:' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') WHEN 1 THEN 'Orphanet:' || s_suppkey WHEN 2 THEN NULL WHEN 3 THEN 'OMIM:PS100000' ELSE 'MeSH:D' || s_suppkey END AS xref FROM supplier""")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X22."""
    pair = "CASE s_suppkey % 5 WHEN 0 THEN named_struct('s', 'mondo', 'r', concat('MONDO_', s_suppkey)) WHEN 1 THEN named_struct('s', 'ORPHA', 'r', concat('', s_suppkey)) WHEN 2 THEN named_struct('s', 'OMIM', 'r', '12') WHEN 3 THEN named_struct('s', 'MIM', 'r', 'PS100000') ELSE named_struct('s', ' MeSH ', 'r', concat('mesh:D', s_suppkey)) END"
    df = read(spark, sf_dir, "supplier").withColumn("x", F.expr(pair))
    return df.select("s_suppkey", T.canonical_xref(F.col("x.s"), F.col("x.r")).alias("xref"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake FROM part")
def snake_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6."""
    return read(spark, sf_dir, "part").select("p_partkey", T.snake_case(F.col("p_name")).alias("snake"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000 + 250 WHEN 2 THEN p_partkey END::BIGINT AS n, CASE p_partkey % 4 WHEN 1 THEN CAST('0.' || p_size AS DOUBLE) WHEN 2 THEN p_partkey END::DOUBLE AS x, CASE p_partkey % 4 WHEN 3 THEN CASE WHEN p_partkey % 8 = 3 THEN p_size + 0.5 END END::DOUBLE AS low FROM part""")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, decimals and intervals; anything else, and an interval that runs backwards, is null."""
    c = F.expr("CASE p_partkey % 4 WHEN 0 THEN p_size || ',250' WHEN 1 THEN ' 0.' || p_size WHEN 2 THEN p_partkey || '' ELSE CASE WHEN p_partkey % 8 = 3 THEN '(' || p_size || '.5-' || (p_size + 1) || ')' ELSE '(' || (p_size + 1) || '-' || p_size || '.5)' END END")
    return read(spark, sf_dir, "part").select("p_partkey", T.count_of(c).alias("n"), T.decimal_of(c).alias("x"), T.interval_of(c)["low"].alias("low"))


@query(r"SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) >= 4 AS sentence_like FROM conversations")
def sentence_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F26."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.sentence_like(F.col("text")).alias("sentence_like"))


@query("SELECT user_id, max(CASE WHEN json_valid(props) THEN json_extract_string(props, '$.ref') END) AS ref, count(*) AS n FROM events GROUP BY 1")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path that isn't there gives null."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.get_json_object("props", "$.ref")).alias("ref"), F.count("*").alias("n"))


@query("SELECT nation || '' AS place, count(*) AS n FROM (SELECT concat_ws(', ', nullif(trim(n_name), ''), nullif(trim(r_name), '')) AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3) GROUP BY 1")
def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X40."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    df = c.join(n, c.c_nationkey == n.n_nationkey).join(r.where("r_regionkey < 3"), n.n_regionkey == r.r_regionkey, "left")
    return df.select(T.place(F.col("n_name"), F.col("r_name")).alias("place")).groupBy("place").agg(F.count("*").alias("n"))
