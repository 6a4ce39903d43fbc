"""Trees and pages: a screen's elements as a tree (node i below i // 2), and what is read from html and urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import trees
from ..session import table
from .boxes import ELEMENTS, elements
from .registry import Registry

_registry = Registry()
query = _registry.query

_TREE = ELEMENTS.replace("with e0", "with recursive e0") + ", t as (select image, idx as node, nullif(idx // 2, 0) as parent, kind from e)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.col("idx") / 2)
    return elements(spark, sf_dir).select("image", F.col("idx").alias("node"), F.when(half > 0, half).alias("parent"), "kind")


@query(_TREE + """, w as (
    select image, node, kind, 0 as depth, lpad(cast(node as varchar), 9, '0') as path from t where parent is null
    union all select t.image, t.node, t.kind, depth + 1, path || '/' || lpad(cast(t.node as varchar), 9, '0') from w join t on t.image = w.image and t.parent = w.node
) select image, cast(node as bigint) as node, row_number() over (partition by image order by path) - 1 as position, cast(depth as bigint) as depth, repeat(chr(9), depth) || kind as line from w""")
def tree_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's line in the indented text of its tree."""
    return trees.outline(_tree(spark, sf_dir), "image", "node", "parent", "kind")


@query(_TREE + """, g as (select image, parent as node from t where parent is not null group by image, parent having count(*) = 1
), x as (select t.*, t.kind = 'N' and g.node is not null as gone from t left join g using (image, node)
), u as (
    select image, node, parent as up from x where not gone
    union all select u.image, u.node, x.parent from u join x on x.image = u.image and x.node = u.up where x.gone
) select u.image, cast(u.node as bigint) as node, cast(u.up as bigint) as up from u left join x on x.image = u.image and x.node = u.up where not coalesce(x.gone, false)""")
def tree_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees without wrappers of a single child."""
    return trees.without_wrappers(_tree(spark, sf_dir), "image", "node", "parent", "kind", "N")


@query(_TREE + """, a as (
    select image, parent as node from t where kind = 'R' and parent is not null
    union select t.image, t.parent from a join t using (image, node) where t.parent is not null
), r as (
    select image, node, 1 as rank from t where kind = 'R' union all select image, node, 2 from a
    union all select c.image, c.node, 3 from t c join t p on p.image = c.image and p.node = c.parent where p.kind = 'R'
    union all select s.image, s.node, 4 from t s join t c on c.image = s.image and c.parent is not distinct from s.parent where c.kind = 'R'
) select image, cast(node as bigint) as node, ['candidate', 'ancestor', 'child', 'sibling'][min(rank)] as why from r group by image, node""")
def tree_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their ancestors, children and siblings."""
    return trees.with_relatives(_tree(spark, sf_dir), "image", "node", "parent", "kind", "R")


@query("select page_id, len(regexp_extract_all(html, '</')) as closing, len(regexp_extract_all(html, '</')) >= 8 as complex from pages")
def closing_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with eight closing tags or more are too complex to describe."""
    n = F.regexp_count("html", F.lit("</")).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n.alias("closing"), (n >= 8).alias("complex"))


@query("select case when contains(url, '/en') then 'english' when regexp_matches(url, '//(m|blog)\\.') then 'mobile' when contains(url, '?') then 'tagged' else 'others' end as label, count(*) as n, count(distinct regexp_extract(url, '//([^/]+)', 1)) as hosts from pages group by 1")
def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from paths; the first rule that holds decides."""
    url = F.col("url")
    label = F.when(url.contains("/en"), "english").when(url.rlike(r"//(m|blog)\."), "mobile").when(url.contains("?"), "tagged").otherwise("others")
    return table(spark, sf_dir, "pages").groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.countDistinct(F.regexp_extract("url", "//([^/]+)", 1)).alias("hosts"))


@query("select page_id, md5(replace(replace(replace(replace(url || '<&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) as escaped, base64(encode(url)) as coded, case when length(url) > 30 then left(url, 13) || '...' || right(url, 14) else url end as short from pages")
def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped, in base64 and shortened in the middle."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.xml_escape(F.concat(url, F.lit("<&>")))).alias("escaped"), T.base64(url).alias("coded"), T.shorten(url, 30, "center").alias("short"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, list_sum(list_transform(regexp_extract_all(url, '\\d+'), lambda x: cast(x as bigint))) as numbers from pages")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title, and the sum of the numbers in the address (null without any)."""
    found = T.integers(F.col("url"))
    total = F.when(F.size(found) > 0, F.aggregate(F.transform(found, lambda x: F.abs(x)), F.lit(0).cast("long"), lambda a, x: a + x))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), total.alias("numbers"))


QUERIES, ORACLES = _registry.queries, _registry.oracles
