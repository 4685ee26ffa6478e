"""Conversation-memory and agent-registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalbook import rules
from signalbook.functions import entities as ent
from signalbook.operators import dialog, registry
from signalbook.plans.catalog import query, table
from signalbook.plans.fixtures import sql_text


def memory(spark, sf):
    """Turns with the agent and category that produced the answers."""
    asst = F.col("role") == "assistant"
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", "text",
        F.when(asst & (F.col("conv_id") % 3 != 0), F.concat(F.lit("Agent"), (F.col("conv_id") % 3).cast("string"))).alias("agent"),
        F.when(asst & (F.col("turn") % 3 == 1), "kpi").when(asst & (F.col("turn") % 3 == 2), "alarm").alias("category"))


_MEM = """mem AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' AND conv_id % 3 <> 0 THEN 'Agent' || conv_id % 3 END AS agent,
  CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'kpi' WHEN role = 'assistant' AND turn % 3 = 2 THEN 'alarm' END AS category FROM conversations),
lr AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN {'t': text, 'c': category} END IGNORE NULLS) OVER w AS l, count(*) OVER w AS prior FROM mem
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("w3_context_at_turn", f"""WITH {_MEM}, c AS (SELECT conv_id, turn, string_agg('[' || upper(role) || coalesce(' via ' || agent, '') || ']: ' || text[1:150], chr(10))
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS s FROM mem)
  SELECT conv_id, turn, CASE WHEN s IS NULL THEN '' ELSE 'Recent conversation:' || chr(10) || s END AS context FROM c""")
def context(spark, sf):
    return dialog.context_at_turn(memory(spark, sf)).select("conv_id", "turn", "context")


@query("w4_last_response", f"WITH {_MEM} SELECT conv_id, turn, l.t AS last_text, l.c AS last_category, prior FROM lr")
def last_response(spark, sf):
    return dialog.last_response(memory(spark, sf)).select("conv_id", "turn", "last_text", "last_category", "prior")


_IND = " OR ".join(f"contains(lower(text), {sql_text(i)})" for i in rules.FOLLOWUP_INDICATORS)


@query("w5_route_turns", f"""WITH {_MEM}, f AS (SELECT *, ({_IND}) AND prior >= 2 AND l.t IS NOT NULL AS followup FROM lr WHERE role = 'user')
  SELECT conv_id, turn, followup, CASE WHEN followup THEN 'Previous context: ' || l.t[1:500] || chr(10) || chr(10) || 'Follow-up question: ' || text ELSE text END AS query,
  CASE WHEN followup AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 8 AND coalesce(l.c, '') <> '' THEN l.c END AS inherited FROM f""")
def route(spark, sf):
    return dialog.route_turns(memory(spark, sf)).select("conv_id", "turn", "followup", "query", "inherited")


# --- registry --------------------------------------------------------------------------------
DOMAINS = ["radio_access", "core_network", "transport_links", "voice", "io"]


def agents(spark, sf):
    """One agent per customer."""
    domains = F.array(*[F.lit(d) for d in DOMAINS])
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("agent_id"), F.concat(F.initcap("c_mktsegment"), F.lit(" Agent")).alias("name"), F.get(domains, (k % 5).cast("int")).alias("domain"),
        F.when(k % 7 == 0, "short").otherwise(F.rpad(F.col("c_name"), 60, ".")).alias("system_prompt"),
        F.split(F.when(k % 4 == 0, F.lit("a,b")).otherwise(F.lit("a,b,c")), ",").alias("keywords"),
        F.split(F.when(k % 6 == 0, F.lit("kpi_lookup,shell")).otherwise(F.lit("kpi_lookup,alarm_query")), ",").alias("tools"),
        F.when(k % 10 == 9, "active").when(k % 10 == 8, "disabled").otherwise("candidate").alias("status"),
        F.date_add(F.lit("2023-12-01").cast("date"), (k % 60).cast("int")).cast("timestamp_ntz").alias("created_at"))


_AG = f"""ag AS (SELECT c_custkey AS agent_id, (['{"', '".join(DOMAINS)}'])[c_custkey % 5 + 1] AS domain, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Agent' AS name,
  CASE WHEN c_custkey % 7 = 0 THEN 'short' ELSE rpad(c_name, 60, '.') END AS system_prompt, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 3 END AS n_keywords, c_custkey % 6 <> 0 AS tools_ok,
  CASE WHEN c_custkey % 10 = 9 THEN 'active' WHEN c_custkey % 10 = 8 THEN 'disabled' ELSE 'candidate' END AS status, TIMESTAMP '2023-12-01' + to_days((c_custkey % 60)::INT) AS created_at FROM customer)"""


def runs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("agent_id"), F.col("ts").alias("created_at"),
        (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency_ms"))


_RUNS = """runs AS (SELECT event_id AS run_id, user_id AS agent_id, ts AS created_at, event_type <> 'error' AS success FROM events),
us AS (SELECT agent_id, count(*) AS use_count, count_if(success)::BIGINT AS success_count, max(created_at) AS last_used FROM runs GROUP BY agent_id),
rr AS (SELECT agent_id, row_number() OVER w AS uses, sum(success::INT) OVER w AS wins FROM runs WINDOW w AS (PARTITION BY agent_id ORDER BY created_at, run_id ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT agent_id, min(uses)::BIGINT AS promoted_at_run FROM rr WHERE uses >= 2 AND wins / uses >= 0.6 GROUP BY agent_id)"""
_LIFE = f"""{_AG}, {_RUNS}, lf AS (SELECT agent_id, CASE WHEN status = 'candidate' AND promoted_at_run IS NOT NULL THEN 'active'
  WHEN status = 'candidate' AND use_count IS NULL AND created_at < TIMESTAMP '2024-01-31' - INTERVAL 30 DAY THEN 'pruned' ELSE status END AS status,
  coalesce(use_count, 0) AS use_count, coalesce(success_count, 0) AS success_count, promoted_at_run FROM ag LEFT JOIN us USING (agent_id) LEFT JOIN pr USING (agent_id))"""


@query("b11_validate_agents", f"WITH {_AG} SELECT agent_id, length(name) >= 3 AND length(domain) >= 3 AND length(system_prompt) >= 50 AND n_keywords >= 3 AND tools_ok AS valid FROM ag")
def validate(spark, sf):
    return registry.validate_agents(agents(spark, sf)).select("agent_id", "valid")


@query("g22_agent_usage", f"WITH {_RUNS} SELECT agent_id, use_count, success_count, strftime(last_used, '%Y-%m-%d %H:%M:%S') AS last_used, round(success_count / use_count, 6) AS rate FROM us")
def usage(spark, sf):
    u = registry.agent_usage(runs(spark, sf))
    return u.select("agent_id", "use_count", "success_count", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss").alias("last_used"), F.round("rate", 6).alias("rate"))


def _lifecycle(spark, sf):
    return registry.lifecycle(agents(spark, sf), runs(spark, sf), F.lit("2024-01-31").cast("timestamp_ntz"))


@query("g23_lifecycle", f"WITH {_LIFE} SELECT agent_id, status, use_count, success_count, promoted_at_run FROM lf")
def lifecycle(spark, sf):
    return _lifecycle(spark, sf).select("agent_id", "status", "use_count", "success_count", "promoted_at_run")


@query("s3_list_agents", f"WITH {_LIFE} SELECT agent_id, status, use_count FROM lf WHERE status <> 'pruned' ORDER BY status, use_count DESC")
def listing(spark, sf):
    return registry.list_agents(_lifecycle(spark, sf)).select("agent_id", "status", "use_count")


@query("g24_registry_stats", f"WITH {_LIFE} SELECT count(*) AS total_agents, count_if(status = 'active')::BIGINT AS active, count_if(status = 'candidate')::BIGINT AS candidates, (SELECT count(*) FROM runs) AS total_runs FROM lf")
def stats(spark, sf):
    return registry.registry_stats(_lifecycle(spark, sf), runs(spark, sf))


# Agents whose keywords are the words of the held-out items; questions are the conversation turns.
def item_agents(spark, sf):
    k = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        k.alias("agent_id"), F.concat(F.lit("that "), k.cast("string"), F.lit(" Agent")).alias("name"), F.concat(F.lit("with_item_"), (k % 3).cast("string")).alias("domain"),
        F.split(F.lower("text"), r"[.,]?\s+").alias("keywords"), F.when(k % 4 == 0, "active").otherwise("candidate").alias("status"))


def turn_questions(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("q_id"), "text", F.concat("role", F.lit("_desk")).alias("domain"))


_ITEM = r"""ia AS (SELECT item_id AS agent_id, CASE WHEN item_id % 4 = 0 THEN 'active' ELSE 'candidate' END AS status,
  list_distinct(list_filter(flatten(list_transform(regexp_split_to_array(lower(text), '[.,]?\s+'), lambda k: regexp_split_to_array(k, '[_\-\s]+'))), lambda w: length(w) >= 3)) AS kw,
  list_filter(['that', item_id::VARCHAR], lambda w: length(w) >= 3) AS nw, ['with', 'item'] AS dw, ['with', 'item', (item_id % 3)::VARCHAR] AS ds FROM benchmark),
tq AS (SELECT conv_id * 100 + turn AS q_id, role, list_distinct(list_filter(regexp_split_to_array(lower(text), '[_\-\s]+'), lambda w: length(w) >= 3)) AS qw FROM conversations)"""


@query("c16_route_by_keywords", f"""WITH {_ITEM}, s AS (SELECT q_id, agent_id, status, len(list_intersect(qw, kw)) + 0.5 * len(list_intersect(qw, nw)) + 0.5 * len(list_intersect(qw, dw)) + CASE WHEN status = 'active' THEN 1 ELSE 0 END AS score FROM tq, ia)
  SELECT q_id, agent_id, score::DOUBLE AS score FROM s WHERE score >= 1.5 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, status, agent_id) = 1""")
def route_keywords(spark, sf):
    return registry.route_by_keywords(turn_questions(spark, sf), item_agents(spark, sf))


@query("c15_similar_domains", f"""WITH {_ITEM}, n AS (SELECT q_id, role, list_distinct(qw || [role, 'desk']) AS ws FROM tq), e AS (SELECT agent_id, ds, list_distinct(kw || ['with', 'item']) AS ws FROM ia),
p AS (SELECT q_id, agent_id FROM n, e WHERE (len(list_intersect(n.ws, e.ws)) >= 3 AND len(list_intersect(n.ws, e.ws)) / least(len(n.ws), len(e.ws)) > 0.3) OR len(list_intersect([role, 'desk'], ds)) >= 1)
  SELECT q_id, min(agent_id) AS agent_id FROM p GROUP BY q_id""")
def similar(spark, sf):
    new = turn_questions(spark, sf).select("q_id", F.array("text").alias("keywords"), "domain")
    return registry.similar_domains(new, item_agents(spark, sf))


# --- keywords over parts ----------------------------------------------------------------------
@query("f39_expand_keywords", r"""WITH x AS (SELECT p_partkey, [p_brand, replace(p_name, ' ', '_'), 'from-' || p_type] AS kw, p_type AS d, p_name || ' with ' || p_brand AS ds FROM part),
 y AS (SELECT p_partkey, list_distinct(list_transform(kw, lambda k: lower(k)) || list_filter(flatten(list_transform(kw, lambda k: regexp_split_to_array(lower(k), '[_\-\s]+'))), lambda w: length(w) >= 3)
   || list_filter(regexp_split_to_array(lower(d), '[_\s]+'), lambda w: length(w) >= 3) || list_filter(regexp_split_to_array(lower(ds), '\s+'), lambda w: length(w) >= 4 AND w NOT IN ('with','from','that','this','also','into','about'))) AS k FROM x)
  SELECT p_partkey, array_to_string(list_sort(k), ',') AS keywords FROM y""")
def expand(spark, sf):
    kw = F.array(F.col("p_brand"), F.replace("p_name", F.lit(" "), F.lit("_")), F.concat(F.lit("from-"), "p_type"))
    out = ent.expand_keywords(kw, F.col("p_type"), F.concat("p_name", F.lit(" with "), "p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(out), ",").alias("keywords"))


@query("f40_normalize_domain", "SELECT p_partkey, replace(replace(lower(p_name || '-' || p_type), ' ', '_'), '-', '_') AS domain, p_brand || '|' || p_type AS keywords FROM part")
def normalize(spark, sf):
    kw = ent.keyword_list(F.concat("p_brand", F.lit(" , "), "p_type"))
    return table(spark, sf, "part").select(
        "p_partkey", ent.normalize_domain(F.concat("p_name", F.lit("-"), "p_type")).alias("domain"), F.array_join(kw, "|").alias("keywords"))
