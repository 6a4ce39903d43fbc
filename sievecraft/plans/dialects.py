"""Other agents' forms of actions, messages and targets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dialects as L
from ..functions import text as T
from ..operators import trees
from ..operators import windows as O
from ..session import table
from .boxes import ELEMENTS, elements
from .pages import _TREE, _tree
from .registry import Registry
from .samples import _PAIRS, pairs

_registry = Registry()
query = _registry.query

_STEPS = """with s as (select event_id, user_id, cast(event_id % 1000 as int) as x, cast(event_id * 7 % 1000 as int) as y, 'word ' || event_type as t,
    ['click', 'input_text', 'select', 'scroll', 'hover', 'swipe', 'hotkey', 'enter', 'open_app', 'drag'][cast(event_id % 10 as int) + 1] as kind from events)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("click", "input_text", "select", "scroll", "hover", "swipe", "hotkey", "enter", "open_app", "drag")])
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", (F.col("event_id") % 1000).cast("int").alias("x"), (F.col("event_id") * 7 % 1000).cast("int").alias("y"), F.concat(F.lit("word "), "event_type").alias("t"), kinds[(F.col("event_id") % 10).cast("int")].alias("kind"))


_AT = "'None, ''position'': [' || x || '.00, ' || y || '.00]}'"
_WAY = "case when x > 500 then 'up' else 'down' end"
_TURNED = "case when x > 500 then 'down' else 'up' end"


def _position_sql(tap: str, swipe: str) -> str:
    return f"""case kind when 'click' then '{{''action'': ''{tap}'', ''value'': ' || {_AT} when 'hover' then '{{''action'': ''HOVER'', ''value'': ' || {_AT} when 'scroll' then '{{''action'': ''SCROLL'', ''value'': ''' || {_WAY} || ''', ''position'': None}}'
        when 'input_text' then '{{''action'': ''INPUT'', ''value'': ''' || t || '''}}' when 'open_app' then '{{''action'': ''OPEN_APP'', ''value'': ''' || t || '''}}' when 'enter' then '{{''action'': ''ENTER'', ''value'': None, ''position'': None}}'
        when 'hotkey' then case when event_id % 3 = 0 then '{{''action'': ''COPY'', ''value'': None, ''position'': None}}' end {swipe} end"""


@query(_STEPS + f""" select event_id, {_position_sql('TAP', '')} as phone, {_position_sql('CLICK', "when 'swipe' then '{''action'': ''SCROLL'', ''value'': ''' || " + _TURNED + " || ''', ''position'': None}'")} as web,
    case kind when 'click' then 'click(start_box=''<|box_start|>(' || x || ',' || y || ')<|box_end|>'')' when 'input_text' then 'type(start_box=''<|box_start|>(' || x || ',' || y || ')<|box_end|>'', content=''' || t || ''')' when 'select' then 'select(start_box=''<|box_start|>(' || x || ',' || y || ')<|box_end|>'', option=''' || t || ''')' end as called,
    case when kind in ('click', 'input_text', 'select') then kind end as kind, case when kind in ('click', 'input_text', 'select') then x::double end as x, case when kind in ('click', 'input_text', 'select') then y::double end as y, case when kind in ('input_text', 'select') then t end as text from s""")
def agent_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified actions with positions, on phones and on the web, and as calls; and what is read back from the calls."""
    kind, x, y = F.col("kind"), F.col("x"), F.col("y")
    text = F.when(kind == "hotkey", F.when(F.col("event_id") % 3 == 0, "Ctrl + C").otherwise("Ctrl-Z")).otherwise(F.col("t"))
    way = F.when(x > 500, "up").otherwise("down")
    called = L.call_form(kind, x, y, text)
    s = _steps(spark, sf_dir).select("event_id", L.position_form(kind, x, y, text, way).alias("phone"), L.position_form(kind, x, y, text, way, web=True).alias("web"), called.alias("called"))
    return s.withColumn("read", L.read_call(F.col("called"))).select("event_id", "phone", "web", "called", "read.kind", "read.x", "read.y", "read.text")


@query(_STEPS + """ select event_id, ['click', 'input_text', 'select', 'scroll'][cast(event_id % 4 as int) + 1] as kind, case event_id % 4 when 0 then x / 1000.0::double when 1 then -1 when 2 then x / 1000.0::double end as x,
    case event_id % 4 when 0 then y / 1000.0::double when 1 then -1 when 2 then y / 1000.0::double end as y, case event_id % 4 when 1 then t when 2 then t when 3 then case when x > 500 then 'up' else 'down' end end as text from s""")
def script_actions_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of scripts as actions."""
    k, x, y = F.col("event_id") % 4, F.format_string("%.3f", F.col("x") / 1000.0), F.format_string("%.3f", F.col("y") / 1000.0)
    at = F.concat(F.lit("x="), x, F.lit(", y="), y)
    line = (
        F.when(k == 0, F.concat(F.lit("pyautogui.click("), at, F.lit(")"))).when(k == 1, F.concat(F.lit("pyautogui.write(message='"), F.col("t"), F.lit("')")))
        .when(k == 2, F.concat(F.lit("browser.select_option("), at, F.lit(", value='"), F.col("t"), F.lit("')"))).otherwise(F.when(F.col("x") > 500, "pyautogui.scroll(page=0.26)").otherwise("pyautogui.scroll(page=-0.26)"))
    )
    return _steps(spark, sf_dir).select("event_id", L.read_script(line).alias("read")).select("event_id", "read.kind", "read.x", "read.y", "read.text")


@query(_STEPS + """, n as (select *, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as n from s)
select user_id, 2 * i as place, 'user' as role, case when i = 0 then 'Task' || chr(10) else '' end || 'Step ' || i || ' observation' || chr(10) || case when i < n - 5 then '** GUI content placeholder **' else 'image ' || event_id end as content from n
union all select user_id, 2 * i + 1, 'assistant', case when event_id % 2 = 0 then 'Thought: go' else ' Thought: ...' end || chr(10) || 'Action: ' || kind from n where i < n - 1""")
def history_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes as messages: the last five observations have pictures, earlier ones a placeholder, and the last no answer."""
    own = Window.partitionBy("user_id")
    n = _steps(spark, sf_dir).select("user_id", "event_id", "kind", (F.row_number().over(own.orderBy("event_id")) - 1).cast("long").alias("i"), F.count("*").over(own).alias("n"))
    step = F.col("i").cast("string")
    seen = F.when(F.col("i") < F.col("n") - 5, "** GUI content placeholder **").otherwise(F.concat(F.lit("image "), F.col("event_id").cast("string")))
    asked = F.concat(F.when(F.col("i") == 0, "Task\n").otherwise(""), F.lit("Step "), step, F.lit(" observation\n"), seen)
    thought = F.when(F.col("event_id") % 2 == 0, "Thought: go").otherwise("")
    told = F.concat(F.when(F.contains(thought, F.lit("Thought:")), thought).otherwise(" Thought: ..."), F.lit("\nAction: "), "kind")
    turn = lambda place, role, content: F.struct(place.alias("place"), F.lit(role).alias("role"), content.alias("content"))
    turns = F.array_compact(F.array(turn(2 * F.col("i"), "user", asked), F.when(F.col("i") < F.col("n") - 1, turn(2 * F.col("i") + 1, "assistant", told))))
    return n.select("user_id", F.explode(turns).alias("m")).select("user_id", "m.place", "m.role", "m.content")


@query(_TREE + """, u as (
    select image, node, parent as up from t where kind <> 'N'
    union all select u.image, u.node, g.parent from u join t g on g.image = u.image and g.node = u.up where g.kind = 'N'
), w as (
    select image, node, kind, lpad(cast(node as varchar), 9, '0') as path from t where parent is null
    union all select t.image, t.node, t.kind, path || '/' || lpad(cast(t.node as varchar), 9, '0') from w join t on t.image = w.image and t.parent = w.node
), p as (select image, node, row_number() over (partition by image order by path) - 1 as position from w where kind <> 'N')
select u.image, cast(u.node as bigint) as node, cast(u.up as bigint) as up, p.position from u left join t g on g.image = u.image and g.node = u.up join p on p.image = u.image and p.node = u.node where g.kind is null or g.kind <> 'N'""")
def tree_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees without bad nodes; their children take their places."""
    return trees.pruned(_tree(spark, sf_dir).withColumn("bad", F.col("kind") == "N"), "image", "node", "parent", "bad")


@query(ELEMENTS + """, r as (select *, 'item of ' || kind || ' .' as phrase, '[' || cast(floor(x1 / 1280.0::double * 1000) as int) || ', ' || cast(floor(y1 / 1280.0::double * 1000) as int) || ', ' || cast(floor(x2 / 1280.0::double * 1000) as int) || ', ' || cast(floor(y2 / 1280.0::double * 1000) as int) || ']' as box, ('0x' || md5('coin|' || image || '|' || idx)[1:1])::int >= 8 as gnd from e)
select image, idx, case when gnd then '<image>' || chr(10) || 'Locate: ' || trim(phrase, ' .') || '.' else 'Describe: ' || box || '.' end as query, case when gnd then box else trim(phrase, ' .') || '.' end as answer from r""")
def region_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region as a sample one way or the other, by a coin that repeats."""
    box = F.concat(F.lit("["), F.array_join(F.array(*[F.floor(F.col(c) / 1280.0 * 1000).cast("string") for c in ("x1", "y1", "x2", "y2")]), ", "), F.lit("]"))
    phrase = F.concat(T.strip(F.concat(F.lit("item of "), "kind", F.lit(" ."))), F.lit("."))
    gnd = F.conv(F.substring(O.hash_rank("coin", "image", "idx"), 1, 1), 16, 10).cast("int") >= 8
    r = elements(spark, sf_dir).select("image", "idx", box.alias("box"), phrase.alias("phrase"), gnd.alias("gnd"))
    return r.select("image", "idx", F.when(F.col("gnd"), F.concat(F.lit("<image>\nLocate: "), "phrase")).otherwise(F.concat(F.lit("Describe: "), "box", F.lit("."))).alias("query"), F.when(F.col("gnd"), F.col("box")).otherwise(F.col("phrase")).alias("answer"))


@query(ELEMENTS + """, p as (select image, (x1 + x2) / 2.0::double as px, (y1 + y2) / 2.0::double as py from e where idx = 1)
select image, min_by(idx, ((x2 - x1) * (y2 - y1), idx)) as idx, min((x2 - x1) * (y2 - y1)) as area from e join p using (image) where px between x1 and x2 and py between y1 and y2 group by image""")
def clicked_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks under the smallest element round them; of equal ones the first."""
    e = elements(spark, sf_dir)
    p = e.where("idx = 1").select("image", ((F.col("x1") + F.col("x2")) / 2).alias("px"), ((F.col("y1") + F.col("y2")) / 2).alias("py"))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    hit = e.join(p, "image").where("px between x1 and x2 and py between y1 and y2")
    return hit.groupBy("image").agg(F.min(F.struct(area.alias("area"), "idx")).alias("m")).select("image", "m.idx", "m.area")


@query("""with w as (select conv_id, turn, role, length(u.w) as id, u.i from conversations, lateral (select unnest(string_split(coalesce(text, ''), ' ')) as w, unnest(range(0, len(string_split(coalesce(text, ''), ' ')))) as i) u)
select conv_id, count(*) + 3 as n, count(*) filter (where role = 'user' and i >= 2) + 3 as hidden, coalesce(sum(id) filter (where role <> 'user' or i < 2), 0)::bigint as kept from w group by conv_id""")
def masked_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with the header of three ids and the users' turns masked: how many there are, how many are hidden, and the sum of the others."""
    ids = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w).cast("long"))
    t = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", (F.col("role") == "user").alias("human"), ids.alias("ids")).alias("t"))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    target = L.masked(F.concat(F.array_repeat(F.lit(0).cast("long"), 3), F.flatten(F.transform("t", lambda x: x["ids"]))), F.lit(3), F.transform("t", lambda x: F.size(x["ids"])), F.transform("t", lambda x: x["human"]))
    c = c.select("conv_id", target.alias("target"))
    seen = F.filter("target", lambda x: x != -100)
    return c.select("conv_id", F.size("target").cast("long").alias("n"), (F.size("target") - F.size(seen)).cast("long").alias("hidden"), F.aggregate(seen, F.lit(0).cast("long"), lambda a, x: a + x).alias("kept"))


_READ = "regexp_replace(regexp_replace(replace(regexp_replace(html, '<text>([^\\n]*?)</text>', '\\1', 'g'), '/>', '$/$>'), '</([^\\n]+?)>', ')', 'g'), '<([^\\n]+?)>', '(\\1', 'g')"
_READ = f"replace({_READ}, '$/$', ')')"
for _k, _v in L._ENTITIES:
    _READ = f"replace({_READ}, '{_k}', '{_v.replace(chr(39), chr(39) * 2)}')"


@query(f"""with t as (select page_id, trim(regexp_replace({_READ}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\pZ]+', ' ', 'g')) as t from pages) select page_id, md5(regexp_replace(regexp_replace(t, '\\) +\\)', '))', 'g'), '\\( +\\(', '((', 'g')) as tree from t""")
def parenthesised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with round brackets for tags."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(L.parenthesised(F.col("html"))).alias("tree"))


@query("""select p_partkey, case lower(split_part(p_type, ' ', 1)) when 'economy' then 'cheap' when 'standard' then 'usual' else split_part(p_type, ' ', 1) end as named, split_part('a_' || p_partkey || '_' || p_size || '-' || p_brand, '_', 2) as first, split_part('a_' || p_partkey || '_' || p_size || '-' || p_brand, '-', -1) as last,
    lower(p_type[1]) || p_type[2:] as lowered, p_name as thought, p_brand as action, case when p_partkey % 2 = 0 then p_name else '' end as plan from part""")
def response_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that people know, parts of ids, sections of answers, and texts without control characters."""
    c = F.col
    key = F.concat_ws("_", F.lit("a"), c("p_partkey").cast("string"), F.concat_ws("-", c("p_size").cast("string"), c("p_brand")))
    answer = F.concat(F.lit("<thought>​"), c("p_name"), F.lit("\u0007</thought> x <action>"), c("p_brand"), F.lit("</action>"), F.when(c("p_partkey") % 2 == 0, F.concat(F.lit("<plan>"), c("p_name"), F.lit("</plan>"))).otherwise(""))
    return table(spark, sf_dir, "part").select(
        "p_partkey", L.friendly(F.split_part("p_type", F.lit(" "), F.lit(1)), {"economy": "cheap", "standard": "usual"}).alias("named"), F.split_part(key, F.lit("_"), F.lit(2)).alias("first"), F.element_at(F.split(key, "-"), -1).alias("last"),
        T.lower_first(c("p_type")).alias("lowered"), T.without_control(T.section(answer, "thought")).alias("thought"), T.section(answer, "action").alias("action"), T.section(answer, "plan").alias("plan"),
    )


@query(_PAIRS + """, c as (select conv_id, count(*) as n from p group by conv_id), s as (select *, sum(n) over (order by md5('prefix|' || conv_id)) - n as before from c)
select conv_id, t.upto, cast(least(n, t.upto - before) as bigint) as kept from s, (values (50), (100), (200)) as t(upto) where before < t.upto""")
def split_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsets of 50, 100 and 200 pairs in hash order; the dialogue at the border is cut."""
    c = pairs(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"))
    s = O.running(c, O.hash_rank("prefix", "conv_id"), "n", "before").withColumn("upto", F.explode(F.array(F.lit(50), F.lit(100), F.lit(200))))
    return s.where("before < upto").select("conv_id", "upto", F.least("n", F.col("upto") - F.col("before")).alias("kept"))


_MORE = "least(2, n - cast(('0x' || md5('pair|' || conv_id)[1:7])::bigint % n as int))"


@query(_PAIRS + f""", c as (select conv_id, count(*) as n from p group by conv_id), m as (select conv_id, n, case when n < 2 then 0 else {_MORE} end as more from c), s as (select *, sum(more) over (order by md5('more|' || conv_id)) - more as before from m)
select conv_id, n, cast(case when before < (select sum(n) // 2 from c) then more else 0 end as bigint) as copies from s""")
def replicated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues of two pairs or more get copies of up to two of their own, in hash order, until half as many pairs again are there."""
    c = pairs(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"))
    at = F.pmod(F.conv(F.substring(O.hash_rank("pair", "conv_id"), 1, 7), 16, 10).cast("long"), F.col("n"))
    m = c.withColumn("more", F.when(F.col("n") < 2, F.lit(0).cast("long")).otherwise(F.least(F.lit(2).cast("long"), F.col("n") - at)))
    want = c.agg(F.expr("sum(n) div 2").alias("want"))
    s = O.running(m, O.hash_rank("more", "conv_id"), "more", "before").crossJoin(F.broadcast(want))
    return s.select("conv_id", "n", F.when(F.col("before") < F.col("want"), F.col("more")).otherwise(0).alias("copies"))


QUERIES, ORACLES = _registry.queries, _registry.oracles
