"""Agents' steps and dialogues: action spaces, context of a step, text gates, scores of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions import denoise as D
from ..functions import text as T
from ..operators import metrics as M
from ..operators import quality as Q
from ..session import table
from .registry import Registry
from .samples import _PAIRS, pairs

_registry = Registry()
query = _registry.query

_W = "(partition by user_id order by ts, event_id)"
# fixed values: the tables' event types and the actions they stand for here
ACTIONS = {"click": "click", "view": "swipe", "signup": "input_text", "purchase": "status", "error": "navigate_back"}
_ACTION_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in ACTIONS.items()) + " else event_type end"


def _order() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(f"select {_ACTION_SQL} as action, count(*) as n, count(distinct user_id) as episodes from events group by 1")
def action_space_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One corpus' actions in the unified space."""
    return _events(spark, sf_dir).groupBy(C.mapped(F.col("event_type"), ACTIONS).alias("action")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("episodes"))


@query("""select event_id, case event_type when 'click' then 'click' when 'view' then 'scroll' when 'signup' then 'input_text' when 'error' then 'hotkey' else 'drag' end as kind,
    case when event_type in ('click', 'purchase') then event_id * 37 % 1000 end as x, case when event_type in ('click', 'purchase') then event_id * 91 % 1000 end as y,
    case event_type when 'signup' then 'user ' || user_id when 'error' then 'ctrl+c' end as text, case when event_type = 'view' then case when event_id % 11 - 5 > 0 then 'up' else 'down' end end as direction from events""")
def script_action_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded script lines as actions."""
    kind, x, y = F.col("event_type"), (F.col("event_id") * 37 % 1000).cast("string"), (F.col("event_id") * 91 % 1000).cast("string")
    line = (
        F.when(kind == "click", F.concat(F.lit("pyautogui.click("), x, F.lit(", "), y, F.lit(")")))
        .when(kind == "view", F.concat(F.lit("pyautogui.scroll("), (F.col("event_id") % 11 - 5).cast("string"), F.lit(")")))
        .when(kind == "signup", F.concat(F.lit('pyautogui.write("user '), F.col("user_id").cast("string"), F.lit('")')))
        .when(kind == "error", F.lit('pyautogui.hotkey("ctrl", "c")'))
        .otherwise(F.concat(F.lit("pyautogui.dragTo("), x, F.lit(", "), y, F.lit(")")))
    )
    return _events(spark, sf_dir).select("event_id", C.script_action(line).alias("a")).select("event_id", "a.*")


@query(f"select event_id, case when event_type = 'error' and lead(event_type) over {_W} = 'signup' then 'focus_field' else event_type end as step from events")
def rename_before_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A placeholder step is renamed once the next step tells what it was."""
    return _events(spark, sf_dir).select("event_id", F.when((F.col("event_type") == "error") & (F.lead("event_type").over(_order()) == "signup"), "focus_field").otherwise(F.col("event_type")).alias("step"))


@query(f"with b as (select coalesce(lag(event_type, 2) over {_W}, '-') || '>' || coalesce(lag(event_type) over {_W}, '-') as before, event_type from events) select before, event_type, count(*) as n from b group by all")
def previous_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows each two steps."""
    back = lambda k: F.coalesce(F.lag("event_type", k).over(_order()), F.lit("-"))
    return _events(spark, sf_dir).select(F.concat(back(2), F.lit(">"), back(1)).alias("before"), "event_type").groupBy("before", "event_type").agg(F.count("*").alias("n"))


@query("select event_id, unnest(['H', 'HL']) as level from events")
def level_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples of each step: by the goal, and by goal and step."""
    return _events(spark, sf_dir).select("event_id", F.explode(F.array(F.lit("H"), F.lit("HL"))).alias("level"))


@query("select user_id, event_id, event_type from events union all select user_id, max_by(event_id, struct_pack(a := ts, b := event_id)), 'complete' from events group by user_id")
def closing_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode with a closing step after its last."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts")
    last = e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).withColumn("event_type", F.lit("complete"))
    return e.drop("ts").unionByName(last)


@query("with c as (select event_type, count(*) as n from events group by 1), s as (select *, n::double / sum(n) over () < 0.2 as few from c) select case when few then 'others' else event_type end as action, few::int as last, cast(sum(n) as bigint) as n from s group by all")
def shares_others_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions by count, rare ones as one class that sorts last."""
    c = _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    few = F.col("n") / F.col("total") < 0.2
    s = c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total")))).select("n", few.alias("few"), F.when(few, "others").otherwise(F.col("event_type")).alias("action"))
    return s.groupBy("action", F.col("few").cast("int").alias("last")).agg(F.sum("n").alias("n"))


@query(f"with s as (select props, event_type = lead(event_type) over {_W} as hit from events) select cast(regexp_extract(props, '\"k\": (\\d+)', 1) as int) as k, count(*) filter (where hit) as num, count(*) as den, round(count(*) filter (where hit)::double / count(*), 6) as rate from s group by 1")
def key_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _events(spark, sf_dir).select(F.regexp_extract("props", r'"k": (\d+)', 1).try_cast("int").alias("k"), (F.col("event_type") == F.lead("event_type").over(_order())).alias("hit"))
    return s.groupBy("k").agg(M.count_if(F.col("hit")).alias("num"), F.count("*").alias("den"), M.ratio(M.count_if(F.col("hit")), F.count("*")).alias("rate"))


@query("select user_id, count(distinct event_type) as kinds, count(distinct props) as texts, count(*) as steps from events group by user_id")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.countDistinct("props").alias("texts"), F.count("*").alias("steps"))


@query("select user_id, max_by(event_type, struct_pack(a := ts, b := event_id)) as state, max_by(value, struct_pack(a := ts, b := event_id)) as value from events group by user_id")
def keyed_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index by key in which later rows replace earlier ones."""
    at = F.struct("ts", "event_id")
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", at).alias("state"), F.max_by("value", at).alias("value"))


@query("select conv_id, turn, coalesce(string_agg(role || ':' || length(coalesce(text, '')), ' ') over (partition by conv_id order by turn, role, text rows between 5 preceding and 1 preceding), '') as context from conversations")
def context_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five turns before each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(-5, -1)
    item = F.concat(F.col("role"), F.lit(":"), F.length(F.coalesce("text", F.lit(""))).cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list(item).over(w), " ").alias("context"))


@query("""with r as (select conv_id, turn, role, text, row_number() over (partition by conv_id, role order by turn, text) as k from conversations)
select u.conv_id, u.k, u.turn as asked, a.turn as answered from r u left join r a on a.conv_id = u.conv_id and a.k = u.k and a.role = 'assistant' where u.role = 'user'""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th question of a dialogue with its k-th answer."""
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text")).alias("k"))
    a = r.where("role = 'assistant'").select("conv_id", "k", F.col("turn").alias("answered"))
    return r.where("role = 'user'").select("conv_id", "k", F.col("turn").alias("asked")).join(a, ["conv_id", "k"], "left")


@query("select conv_id, turn, case when contains(text, '{') or contains(text, '}') then 'braces' when coalesce(text, '') = '' then 'empty' when length(text) > 60 then 'long' else 'kept' end as reason from conversations")
def instruction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    checks = [("braces", text.contains("{") | text.contains("}")), ("empty", F.coalesce(text, F.lit("")) == ""), ("long", F.length(text) > 60)]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(Q.first_reason(checks), F.lit("kept")).alias("reason"))


@query("with c as (select conv_id, coalesce(text, '') || case when turn % 3 = 1 then ' [0.' || turn || ', 0.25,-1.5 , 2.0 ]' when turn % 3 = 2 then ' [1, 2, 3, 4]' else '' end as t from conversations) select conv_id, count(*) filter (where regexp_matches(t, '" + D.BRACKETED_BOX + "')) as grounded, count(*) filter (where not regexp_matches(t, '" + D.BRACKETED_BOX + "')) as plain from c group by conv_id")
def grounding_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each dialogue with and without a box of four fractions in brackets."""
    box = F.when(F.col("turn") % 3 == 1, F.concat(F.lit(" [0."), F.col("turn").cast("string"), F.lit(", 0.25,-1.5 , 2.0 ]"))).when(F.col("turn") % 3 == 2, " [1, 2, 3, 4]").otherwise("")
    has = F.concat(F.coalesce("text", F.lit("")), box).rlike(D.BRACKETED_BOX)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(M.count_if(has).alias("grounded"), M.count_if(~has).alias("plain"))


@query(_PAIRS + "select conv_id, cast((k - 1) // 2 as bigint) as sample, count(*) as n, string_agg(md5(question), ' ' order by k) as questions from p group by 1, 2")
def fixed_turn_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pairs a sample."""
    packed = pairs(spark, sf_dir).groupBy("conv_id", F.floor((F.col("k") - 1) / 2).alias("sample"))
    items = F.array_sort(F.collect_list(F.struct("k", F.md5("question").alias("q"))))
    return packed.agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda s: s["q"]), " ").alias("questions"))


_WORDS = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> '')"


@query(_PAIRS + f""", a as (select conv_id, k, len(q) + len(r) as total, q, r from (select conv_id, k, {_WORDS.format('question')} as q, {_WORDS.format('answer')} as r from p)
), qc as (select conv_id, k, w, count(*) as n from (select conv_id, k, unnest(q) as w from a) group by all), rc as (select conv_id, k, w, count(*) as n from (select conv_id, k, unnest(r) as w from a) group by all
), m as (select conv_id, k, sum(least(qc.n, rc.n)) as same from qc join rc using (conv_id, k, w) group by all)
select conv_id, k, round(case when total = 0 then 1.0::double else 2.0::double * coalesce(same, 0) / total end, 6) as f1 from a left join m using (conv_id, k)""")
def bag_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of question and answer by words, each occurrence counted."""
    w = lambda c: T.words(F.lower(c))
    return pairs(spark, sf_dir).select("conv_id", "k", F.round(C.bag_f1(w(F.col("question")), w(F.col("answer"))), 6).alias("f1"))


@query(_PAIRS + f""", a as (select conv_id, k, {_WORDS.format('question')} as q, {_WORDS.format('answer')} as r from p), o as (select unnest([1, 2, 3, 4]) as n
), g as (select conv_id, k, n, 0 as side, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) as gram from a, o
    union all select conv_id, k, n, 1, unnest(list_transform(range(1, len(q) - n + 2), lambda i: array_to_string(q[i:i + n - 1], ' '))) from a, o
), c as (select conv_id, k, n, gram, count(*) filter (where side = 0) as guess, count(*) filter (where side = 1) as ref from g group by all
), s as (select n, cast(sum(least(guess, ref)) as bigint) as hits, cast(sum(guess) as bigint) as total, cast(sum(ref) as bigint) as refs from c group by n)
select n, hits, total, refs, round(hits::double / total, 6) as precision, round(case when max(case when n = 1 then total end) over () >= max(case when n = 1 then refs end) over () then 1.0::double else exp(1 - max(case when n = 1 then refs end) over ()::double / max(case when n = 1 then total end) over ()) end, 6) as brevity from s""")
def corpus_bleu_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What BLEU is made of: clipped matches by n-gram length over the corpus, and the brevity penalty."""
    def grams(c: str) -> Column:
        words = T.words(F.lower(F.col(c)))
        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.struct(n.alias("n"), F.array_join(F.slice(words, i, n), " ").alias("gram")))).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))))

    p = pairs(spark, sf_dir)
    side = lambda c, guess: p.select("conv_id", "k", F.explode(grams(c)).alias("g"), F.lit(guess).alias("guess"))
    g = side("answer", True).unionByName(side("question", False)).groupBy("conv_id", "k", "g.n", "g.gram").agg(M.count_if(F.col("guess")).alias("guess"), M.count_if(~F.col("guess")).alias("ref"))
    s = g.groupBy("n").agg(F.sum(F.least("guess", "ref")).alias("hits"), F.sum("guess").alias("total"), F.sum("ref").alias("refs"))
    one = s.where("n = 1").select(F.round(F.when(F.col("total") >= F.col("refs"), F.lit(1.0)).otherwise(F.exp(1 - F.col("refs") / F.col("total"))), 6).alias("brevity"))
    return s.crossJoin(F.broadcast(one)).select("n", "hits", "total", "refs", M.ratio(F.col("hits"), F.col("total")).alias("precision"), "brevity")


@query("select doc_id, case when contains(text, 'I can''t') or contains(text, 'sorry') then 'keyword' when not regexp_full_match(text, '[\\x00-\\x7F]*') then 'script' else 'kept' end as gate from documents")
def text_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with bad keywords, then texts beyond ASCII."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(Q.first_reason([("keyword", D.has_any(text, D.REFUSALS)), ("script", ~text.rlike(r"^[\x00-\x7F]*\z"))]), F.lit("kept")).alias("gate"))


@query("select doc_id, coalesce(cast(l.quality as varchar), 'FAILED') as first, coalesce(cast(b.item_id as varchar), 'FAILED') as second, coalesce(cast(l.quality as varchar), cast(b.item_id as varchar), lang) as final from documents d left join labels l using (doc_id) left join benchmark b on b.item_id = d.doc_id")
def ensemble_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of answers beside a problem; the arbiter's where both failed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    first = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("a"))
    second = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id").cast("string").alias("b"))
    failed = F.lit("FAILED")
    return d.join(first, "doc_id", "left").join(second, "doc_id", "left").select("doc_id", F.coalesce("a", failed).alias("first"), F.coalesce("b", failed).alias("second"), F.coalesce("a", "b", "lang").alias("final"))


@query("select doc_id, count(*) as lines, count(*) filter (where line <> '') as filled from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by doc_id")
def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list answer's lines; counted inside the row, as no row needs to be made of them."""
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: x != "")).cast("long").alias("filled"))


QUERIES, ORACLES = _registry.queries, _registry.oracles
