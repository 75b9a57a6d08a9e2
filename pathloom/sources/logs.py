"""URL logs: readers, and logs derived from relational tables. A log is (obs_id, url); obs_id gives the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import numbered, spread


def literal_log(spark: SparkSession, urls: list[str]) -> DataFrame:
    """A log of given URLs."""
    return spark.createDataFrame(list(enumerate(urls, 1)), "obs_id long, url string")


def text_file(spark: SparkSession, path: str, *, whole: bool = False) -> DataFrame:
    """(line_id, text): lines of text files, or whole files, numbered from 1 on by the file's name, then by place."""
    df = spark.read.text(path, wholetext=whole).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    return numbered(df, "line_id", by=[F.col("_path"), F.col("_start")]).select("line_id", "text")


def union_logs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both logs in one, the second after the first."""
    last = first.agg(F.coalesce(F.max("obs_id"), F.lit(0)).alias("_last"))
    moved = second.join(F.broadcast(last)).select((F.col("obs_id") + F.col("_last")).alias("obs_id"), "url")
    return first.select("obs_id", "url").union(moved)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str, name: str, *exprs: str) -> DataFrame:
    return spread(_t(spark, sf_dir, name).selectExpr(*exprs))


def log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, "pages", "page_id obs_id", "url")


def log_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, "orders", "o_orderkey obs_id", "concat('https://api.example.com/v1/customers/', o_custkey, '/orders/', o_orderkey, '?status=', o_orderstatus, '&date=', cast(o_orderdate as date)) url")


def log_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, "customer", "c_custkey obs_id", "concat('https://crm.example.com/segments/', lower(c_mktsegment), '/customers/cus_', c_custkey) url")


def log_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, "customer", "c_custkey obs_id", "concat('https://www.example.org/workspaces/ws', translate(cast(c_custkey as string), '0123456789', 'abcdefghij')) url")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, "events", 
        "event_id obs_id",
        "concat('https://', if(event_id % 2 = 1, 'api', 'www'), '.example.net/', event_type, '/', user_id, '?code=', 200 + event_id % 20, '&year=', 1990 + event_id % 40, '&v=', cast(value as decimal(12,2)), '&k=', event_id) url",
    )


def log_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One URL a line item, numbered by order, then by its place in the order (of 4,096 at most)."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]
    return _log(spark, sf_dir, "lineitem", *columns).selectExpr(
        "l_orderkey * 4096 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) obs_id",
        "concat('https://shop.example.com/orders/', l_orderkey, '/items/', l_linenumber, '?flag=', l_returnflag, '&qty=', cast(l_quantity as int), '&disc=', cast(l_discount as decimal(12,2)), '&size=', if(l_linenumber % 2 = 0, cast(cast(l_quantity as int) as string), cast(cast(l_quantity + 0.5 as decimal(12,1)) as string))) url",
    )


def log_urns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, "part", "explode(array(struct(2 * p_partkey as obs_id, concat('urn:isbn:', p_partkey + 1000000) as url), struct(2 * p_partkey + 1 as obs_id, concat('mailto:u', p_partkey, '@example.com') as url))) as e").select("e.*")


def log_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs whose parameters repeat, lack a value or a name."""
    return _log(spark, sf_dir, "orders", "o_orderkey obs_id", "concat('https://api.example.com/o?a=', o_orderkey % 7, '&b&a=', o_orderkey % 5, '&=', o_orderkey, '&c=&b=', o_orderstatus, if(o_orderkey % 3 = 0, '&a', ''), '&&d=x=', o_orderkey % 2) url")


def log_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are no URLs, each in its own way, with white space around some, and one in seven that is."""
    return _log(
        spark, sf_dir, "part", "p_partkey obs_id",
        "case p_partkey % 7 when 0 then concat(' https://a', p_partkey, '.com:8080/x \t') when 1 then '  ' when 2 then if(p_partkey % 2 = 0, 'urn:', 'URN:') when 3 then concat('h', p_partkey, ':') when 4 then concat('word', p_partkey) when 5 then concat('http://', if(p_partkey % 2 = 0, ':80/x', '/y')) else concat('https://b.com:', p_partkey, '99999999999999999999/') end url",
    )


def text_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs of pages in texts of many kinds: bracketed, quoted, glued to words, without a scheme, followed by punctuation."""
    rest = "regexp_replace(url, '^[a-z]+://', '')"
    return _log(
        spark, sf_dir, "pages", "page_id",
        f"""case page_id % 12 when 0 then concat('See (', url, '), then ', url, '. Done') when 1 then concat('<', url, '>') when 2 then concat('x', url) when 3 then concat(url, '!!? or ', url, ').')
        when 4 then concat('[', url, '](', url, '/a)') when 5 then concat(upper(substring(url, 1, 4)), substring(url, 5)) when 6 then concat('\u201c', url, '\u201d\u3010', url, '\u3011') when 7 then concat('visit ', {rest}, '; bye')
        when 8 then concat('user@', {rest}) when 9 then concat('urn:isbn:', page_id, '; mailto:a@b.com ', url, '/(a)b)}}]') when 10 then null else concat('a_', url, ' ', url, ':\t', url, '...') end text""",
    )


def log_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with hosts in many scripts and cases, default and other ports, and white space around them."""
    parts = "element_at(array('http', 'https', 'ftp', 'ws', 'WSS'), int(p_partkey % 5 + 1)), '://', element_at(array('Shop.EXAMPLE.com', 'M\u00dcNCHEN.de', '\u0141\u00d3D\u0179.pl', '\u041f\u0420\u0418\u041c\u0415\u0420.\u0420\u0424', '\u4f8b\u3048.jp', 'LOCALHOST'), int(p_partkey % 6 + 1)), ':', element_at(array('80', '443', '21', '8080', '080', '0'), int(p_partkey % 36 div 6 + 1))"
    return _log(spark, sf_dir, "part", "p_partkey obs_id", f"concat(' \t', {parts}, '/A/', p_partkey, ' ') url")
