"""Names resolved against a register: exact, misspelt in many ways, and like none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import entity
from tidemark.plans.catalog import NORMAL, lcs_sql, query, set_ratio_sql

#: A part's name by its key: with a legal form; a character lost; its words the other way round and a character lost; like none.
NAMED = """named AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' Ltd.') WHEN 1 THEN concat(substring(p_name, 1, p_partkey % length(p_name)), substring(p_name, p_partkey % length(p_name) + 2))
  WHEN 2 THEN concat(substring(w, 1, p_partkey % length(w)), substring(w, p_partkey % length(w) + 2)) ELSE concat('zzqq ', CAST(p_partkey % 50 AS STRING), ' xyw') END AS name
FROM (SELECT p_partkey, p_name, trim(concat({last}, ' ', {first})) AS w FROM part))"""
NAMED_DUCK = NAMED.format(last="string_split(p_name, ' ')[-1]", first="array_to_string(string_split(p_name, ' ')[:-2], ' ')")
NAMED_SPARK = NAMED.format(last="element_at(split(p_name, ' '), -1)", first="array_join(slice(split(p_name, ' '), 1, size(split(p_name, ' ')) - 1), ' ')").replace("FROM part", "FROM {part}")
#: Pairs of names and register with the ratio of their sorted words, and of each name its best.
SCORED = rf"""reg AS (SELECT p_name AS name, sum(p_retailprice) AS weight, min(p_partkey) AS first FROM part GROUP BY 1),
nn AS (SELECT name, {NORMAL.format("name")} AS norm FROM named), n2 AS (SELECT name, norm, array_to_string(list_sort(string_split(norm, ' ')), ' ') AS a FROM nn),
rn AS (SELECT name AS match, weight, first, {NORMAL.format("name")} AS norm FROM reg), r2 AS (SELECT *, array_to_string(list_sort(string_split(norm, ' ')), ' ') AS b FROM rn),
lc AS ({lcs_sql("SELECT DISTINCT a, b FROM (SELECT DISTINCT a FROM n2 WHERE length(a) >= 3), (SELECT DISTINCT b FROM r2 WHERE length(b) >= 3)")}),
sc AS (SELECT name, match, weight, 200.0::DOUBLE * n / (length(a) + length(b)) AS score FROM n2 JOIN lc USING (a) JOIN r2 USING (b)),
best AS (SELECT name, match, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, weight DESC, match DESC) AS k FROM sc) WHERE k = 1),
ex AS (SELECT name, arg_max(match, first) AS match FROM nn JOIN rn USING (norm) GROUP BY 1),
told AS (SELECT n.name, coalesce(ex.match, CASE WHEN score >= 92 THEN best.match END) AS match, CASE WHEN ex.match IS NOT NULL THEN 'exact' WHEN score >= 92 THEN 'fuzzy' ELSE 'none' END AS how FROM named n LEFT JOIN ex USING (name) LEFT JOIN best USING (name))"""


def _named(t) -> DataFrame:
    return t.spark.sql(f"WITH {NAMED_SPARK} SELECT name FROM named", part=t.part)


def _register(t) -> DataFrame:
    return t.part.groupBy(F.col("p_name").alias("name")).agg(F.sum("p_retailprice").alias("weight"), F.min("p_partkey").alias("seq"))


@query(f"WITH {NAMED_DUCK}, {SCORED} SELECT name AS left_name, match AS right_name, round(score, 4) AS score FROM best WHERE score >= 75")
def token_sort_match(t):
    """Each name's best of the register, at 75 of 100."""
    return entity.best_match(_named(t), _register(t), 75.0)


@query(f"WITH {NAMED_DUCK}, {SCORED} SELECT name, match, how FROM told")
def resolve_names(t):
    return entity.resolve(_named(t), _register(t))


@query(f"WITH {NAMED_DUCK}, {SCORED} SELECT count(*) FILTER (how <> 'none') AS resolved, count(*) FILTER (how = 'none') AS unresolved, count(*) AS total FROM told")
def resolved_counts(t):
    told = entity.resolve(_named(t), _register(t))
    return told.agg(F.count_if(F.col("how") != "none").alias("resolved"), F.count_if(F.col("how") == "none").alias("unresolved"), F.count("name").alias("total"))


@query(f"WITH {NAMED_DUCK}, {SCORED} SELECT name FROM told WHERE how = 'none'")
def unresolved_names(t):
    return entity.resolve(_named(t), _register(t)).filter("how = 'none'").select("name")


#: A code that is known tells the company whatever the name; every seventh company has no cin.
ASKED = "SELECT name, CASE WHEN length(name) % 3 = 0 THEN CAST(length(name) AS STRING) END AS scrip_code FROM named"


@query(
    f"""WITH {NAMED_DUCK}, asked AS ({ASKED}), comp AS (SELECT min(p_partkey) AS k, p_name AS name FROM part GROUP BY 2), known AS (SELECT k::STRING AS scrip_code, name, 'L' || k AS cin FROM comp WHERE k % 7 > 0),
codes AS (SELECT scrip_code, cin FROM known), left_over AS (SELECT a.* FROM asked a LEFT JOIN codes USING (scrip_code) WHERE cin IS NULL),
nn AS (SELECT name, {NORMAL.format("name")} AS norm FROM left_over), n2 AS (SELECT name, norm, array_to_string(list_sort(string_split(norm, ' ')), ' ') AS a FROM nn), rn AS (SELECT name AS match, scrip_code, cin, {NORMAL.format("name")} AS norm FROM known),
r2 AS (SELECT *, array_to_string(list_sort(string_split(norm, ' ')), ' ') AS b FROM rn), ex AS (SELECT name, arg_max(cin, scrip_code) AS cin FROM nn JOIN rn USING (norm) GROUP BY 1),
lc AS ({lcs_sql("SELECT DISTINCT a, b FROM (SELECT DISTINCT a FROM n2 WHERE length(a) >= 3), (SELECT DISTINCT b FROM r2 WHERE length(b) >= 3)")}),
best AS (SELECT name, arg_max(cin, (200.0::DOUBLE * n / (length(a) + length(b)), match)) AS cin, max(200.0::DOUBLE * n / (length(a) + length(b))) AS score FROM n2 JOIN lc USING (a) JOIN r2 USING (b) GROUP BY 1)
SELECT a.name, a.scrip_code, coalesce(c.cin, ex.cin, CASE WHEN score >= 92 THEN best.cin END) AS cin, CASE WHEN c.cin IS NOT NULL THEN 'scrip' WHEN ex.cin IS NOT NULL THEN 'exact' WHEN score >= 92 THEN 'fuzzy' ELSE 'none' END AS how
FROM asked a LEFT JOIN codes c USING (scrip_code) LEFT JOIN ex USING (name) LEFT JOIN best USING (name)"""
)
def company_cins(t):
    asked = t.spark.sql(f"WITH {NAMED_SPARK} {ASKED}", part=t.part)
    companies = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k"))
    companies = companies.select(F.col("k").cast("string").alias("scrip_code"), "name", F.when(F.col("k") % 7 > 0, F.concat(F.lit("L"), F.col("k").cast("string"))).otherwise("").alias("cin"))
    return entity.resolve_companies(asked, companies)


@query(f"WITH {NAMED_DUCK}, reg AS (SELECT DISTINCT p_name AS y FROM part), {set_ratio_sql('st', 'SELECT DISTINCT upper(name) AS x, upper(y) AS y FROM named, reg')} SELECT x AS a, y AS b, round(score, 4) AS score FROM st WHERE score >= 75")
def token_set_match(t):
    """All pairs of a name and the register, in capitals, whose ratio of word sets is 75 or more."""
    from tidemark.operators import similarity

    pairs = similarity.alike_by_words(_named(t).select(F.upper("name").alias("s")), t.part.select(F.upper("p_name").alias("s")), 75.0)
    return pairs.withColumn("score", F.round(entity.token_set_ratio(F.col("a"), F.col("b")), 4)).filter("score >= 75")


@query()
def tender_winner_ratios(t):
    """Tenders whose winners' names are misspelt, with the ratio that finds their company."""
    tenders = t.orders.select(F.col("o_orderkey").alias("tender_id"), (F.col("o_orderkey") % 200).alias("k"))
    winners = t.part.filter("p_partkey < 200").select(F.col("p_partkey").alias("k"), F.expr("concat(substring(p_name, 1, p_partkey % length(p_name)), 'e', substring(p_name, p_partkey % length(p_name) + 2), CASE WHEN p_partkey % 2 = 0 THEN ' Ltd' ELSE ' LIMITED' END)").alias("winner"))
    companies = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("string").alias("scrip_code"))
    won = entity.tender_winners(tenders.join(F.broadcast(winners), "k").select("tender_id", "winner"), companies)
    return won.select("tender_id", "winner", "scrip_code", F.round("ratio", 4).alias("ratio"))
