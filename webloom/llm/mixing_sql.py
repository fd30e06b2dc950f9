"""The production parameters of the mixing query, and its SQL."""

from pyspark.sql import functions as F

# The tree's domains by source, and the weights of its nodes.
DOMAINS = {"web": ("src0", "src1", "src2", "src3", "src4"), "books": ("src5", "src6", "src7", "src8", "src9"), "reference": ("src10", "src11", "src12", "src13", "src14")}
OTHER = "forum"
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "reference": 2}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2}
SOURCE_WEIGHTS = {"src0": 3, "src5": 2}
EPOCHS, SEED, SHARE = 2, 17, 0.9


def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 1 END"


_DOMAIN = "CASE " + " ".join(f"WHEN source IN ({', '.join(map(repr, s))}) THEN '{d}'" for d, s in DOMAINS.items()) + f" ELSE '{OTHER}' END"


def levels() -> dict:
    return {"domain": F.expr(_DOMAIN), "lang": F.col("lang"), "source": F.col("source")}


def weights() -> dict:
    return {"domain": F.expr(_case("domain", DOMAIN_WEIGHTS)), "lang": F.expr(_case("lang", LANG_WEIGHTS)), "source": F.expr(_case("source", SOURCE_WEIGHTS))}


def _fill_sql(name: str, nodes: str, parent: tuple[str, ...], child: str) -> str:
    """Common table expressions that split the parents' budgets over their children."""
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    columns = ", ".join((*parent, child))
    return f"""
{name}_a AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY ratio, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER ({by} ORDER BY ratio, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM (SELECT *, CASE WHEN w <= 0 THEN 0.0::DOUBLE ELSE cap::DOUBLE / w END AS ratio FROM {nodes})),
{name}_b AS (SELECT *, cap::HUGEINT * rest <= (given - before)::HUGEINT * w AS is_full FROM {name}_a),
{name}_c AS (SELECT *, given - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS free,
  sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by}) AS every,
  sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by} ORDER BY ratio, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {name}_b),
{name} AS (SELECT {columns}, (CASE WHEN is_full THEN cap ELSE (free::HUGEINT * upto) // nullif(every, 0) - (free::HUGEINT * (upto - w)) // nullif(every, 0) END)::BIGINT AS budget FROM {name}_c)"""


SQL = rf"""
WITH stock AS (SELECT doc_id, {_DOMAIN} AS domain, lang, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, {_case("source", SOURCE_WEIGHTS)} AS w, sum(n_tokens)::BIGINT * {EPOCHS} AS cap FROM stock GROUP BY domain, lang, source),
l2 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, {_case("lang", LANG_WEIGHTS)} AS w FROM leaf GROUP BY domain, lang),
l1 AS (SELECT domain, sum(cap)::BIGINT AS cap, {_case("domain", DOMAIN_WEIGHTS)} AS w FROM l2 GROUP BY domain),
g1 AS (SELECT *, least((SELECT floor(sum(n_tokens) * {SHARE}::DOUBLE)::BIGINT FROM stock), (SELECT sum(cap) FROM l1)::BIGINT) AS given FROM l1),
{_fill_sql("b1", "g1", (), "domain")},
g2 AS (SELECT l2.*, b1.budget AS given FROM l2 JOIN b1 ON l2.domain IS NOT DISTINCT FROM b1.domain),
{_fill_sql("b2", "g2", ("domain",), "lang")},
g3 AS (SELECT leaf.*, b2.budget AS given FROM leaf JOIN b2 ON leaf.domain IS NOT DISTINCT FROM b2.domain AND leaf.lang IS NOT DISTINCT FROM b2.lang),
{_fill_sql("b3", "g3", ("domain", "lang"), "source")},
plan AS (SELECT leaf.domain, leaf.lang, leaf.source, tokens, budget, budget // tokens AS epoch, budget % tokens AS remainder FROM leaf JOIN b3
  ON leaf.domain IS NOT DISTINCT FROM b3.domain AND leaf.lang IS NOT DISTINCT FROM b3.lang AND leaf.source IS NOT DISTINCT FROM b3.source WHERE tokens > 0 AND budget > 0),
placed AS (SELECT stock.*, tokens, budget, epoch, remainder, md5('{SEED}|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')) AS place FROM stock JOIN plan
  ON stock.domain IS NOT DISTINCT FROM plan.domain AND stock.lang IS NOT DISTINCT FROM plan.lang AND stock.source IS NOT DISTINCT FROM plan.source),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, (epoch + CASE WHEN upto <= remainder THEN 1 ELSE 0 END)::BIGINT AS copies, tokens AS leaf_tokens, budget AS leaf_budget
FROM run WHERE epoch + CASE WHEN upto <= remainder THEN 1 ELSE 0 END > 0
"""
