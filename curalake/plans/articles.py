"""Citations and full texts in the archives' own elements, made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.functions import articles as A
from curalake.plans.registry import query, read
from curalake.sources.shared import dealt

_RECORD = """CASE p_partkey % 8
    WHEN 6 THEN '<PubmedArticleSet></PubmedArticleSet>'
    WHEN 7 THEN '<PubmedArticleSet><PubmedArticle><MedlineCitation>' || p_name
    WHEN 5 THEN '<PubmedArticleSet><PubmedBookArticle><BookDocument><PMID Version="1">' || p_partkey || '</PMID><ArticleIdList><ArticleId IdType="doi">10.2/b' || p_size || '</ArticleId></ArticleIdList><Book><BookTitle>' || p_type
        || '</BookTitle><PubDate><Year>' || (1980 + p_size) || '</Year></PubDate><AuthorList Type="editors"><Author><LastName>Ed</LastName><Initials>E</Initials></Author></AuthorList></Book>'
        || CASE WHEN p_size % 2 = 0 THEN '<ArticleTitle>' || p_name || '</ArticleTitle>' ELSE '' END || '</BookDocument></PubmedBookArticle></PubmedArticleSet>'
    ELSE '<PubmedArticleSet><PubmedArticle><MedlineCitation Status="MEDLINE"><PMID Version="1">' || p_partkey || '</PMID><Article><Journal>' || CASE WHEN p_size % 3 > 0 THEN '<Title>' || p_type || ' &amp; co</Title>' ELSE '' END
        || '<ISOAbbreviation>' || p_brand || '</ISOAbbreviation><JournalIssue><PubDate>' || CASE p_partkey % 4 WHEN 0 THEN '<Year>' || (1980 + p_size) || '</Year><Month>Nov</Month>' WHEN 1 THEN '<MedlineDate>' || (1980 + p_size) || ' Nov-Dec</MedlineDate>' WHEN 2 THEN '<Year>' || (1980 + p_size) || '</Year>' ELSE '' END
        || '</PubDate></JournalIssue></Journal><ArticleTitle>On <i>' || p_name || '</i> in mice</ArticleTitle><AuthorList><Author><LastName>Abel</LastName><Initials>K' || p_size || '</Initials></Author>'
        || CASE WHEN p_size % 2 = 0 THEN '<Author><CollectiveName>The ' || p_brand || '  Group</CollectiveName></Author>' ELSE '' END || '<Author><LastName>Dorn</LastName></Author></AuthorList>' || CASE WHEN p_size % 5 = 0 THEN '<ELocationID EIdType="pii">x</ELocationID><ELocationID EIdType="doi"> 10.1/e' || p_partkey || ' </ELocationID>' ELSE '' END
        || '</Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">1</ArticleId>' || CASE WHEN p_size % 4 = 0 THEN '<ArticleId IdType="doi">10.1/' || p_partkey || '</ArticleId>' ELSE '' END
        || '</ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType="doi">10.9/cited</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle></PubmedArticleSet>' END"""


@query("""WITH p AS (SELECT *, CASE p_partkey % 8 WHEN 6 THEN 'none' WHEN 7 THEN 'broken' WHEN 5 THEN 'book' ELSE 'article' END AS state, p_partkey % 8 < 5 AS a, p_partkey % 8 = 5 AS b FROM part)
    SELECT p_partkey, state, CASE WHEN a OR b THEN CAST(p_partkey AS VARCHAR) END AS pmid, CASE WHEN a THEN 'On ' || p_name || ' in mice' WHEN b THEN CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END END AS title,
    CASE WHEN a THEN CASE WHEN p_size % 3 > 0 THEN p_type || ' & co' ELSE p_brand END WHEN b THEN p_type END AS journal,
    CASE WHEN a THEN 'Abel K' || p_size || CASE WHEN p_size % 2 = 0 THEN ', The ' || p_brand || ' Group' ELSE '' END || ', Dorn' WHEN b THEN 'Ed E' END AS authors,
    CASE WHEN a THEN CASE p_partkey % 4 WHEN 0 THEN 'Nov ' || (1980 + p_size) WHEN 1 THEN (1980 + p_size) || ' Nov-Dec' WHEN 2 THEN CAST(1980 + p_size AS VARCHAR) END WHEN b THEN CAST(1980 + p_size AS VARCHAR) END AS date,
    CASE WHEN a THEN CASE WHEN p_size % 4 = 0 THEN '10.1/' || p_partkey WHEN p_size % 5 = 0 THEN '10.1/e' || p_partkey END WHEN b THEN '10.2/b' || p_size END AS doi FROM p""")
def citation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and chapters with marked-up titles, mixed dates and group authors; empty sets and broken records told apart."""
    return dealt(read(spark, sf_dir, "part")).select("p_partkey", A.citation(F.expr(_RECORD)).alias("c")).select("p_partkey", "c.*")


_SPACE = "[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query(rf"""WITH d AS (SELECT doc_id, source, text, trim(regexp_replace(source, '{_SPACE}', ' ', 'g')) AS head, list_filter([trim(regexp_replace(x, '{_SPACE}', ' ', 'g')) FOR x IN string_split(coalesce(text, ''), chr(10))], lambda x: x <> '') AS lines FROM documents)
    SELECT doc_id, md5(array_to_string(list_concat([head], lines, ['Item | ' || doc_id || ' | ', 'Float ' || doc_id]), chr(10))) AS body FROM d""")
def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an article in sections, with a table, references and a group of floats; read back as its blocks."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), escaped(x), F.lit("</p>")))
    xml = F.concat(
        F.lit("<article><front><p>front</p></front><floats-group><fig><caption><p>Float "), F.col("doc_id").cast("string"), F.lit("</p></caption></fig></floats-group><body><sec><title>"), escaped(F.col("source")), F.lit("</title><sec>"),
        F.array_join(lines, ""), F.lit("</sec><table-wrap><table><tr><th>Item</th><td><p>"), F.col("doc_id").cast("string"), F.lit("</p></td><td/></tr><tr><td/></tr></table></table-wrap></sec><ref-list><title>References</title><p>cited</p></ref-list></body></article>"),
    )
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(A.full_text(xml).cast("binary")).alias("body"))
