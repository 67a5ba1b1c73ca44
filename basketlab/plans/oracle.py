"""The same queries as plain SQL over the same parquet tables, for cross-checking."""

from __future__ import annotations

from basketlab.functions.columns import HASH_MODULUS, HASH_MULTIPLIER, HASH_SEED_MULTIPLIER
from basketlab.operators import lloyd
from basketlab.operators.recommend import CLUSTER_WEIGHTS, OTHER_WEIGHTS
from basketlab.operators.segment import CARD_DESCRIPTIONS, DESCRIPTIONS
from basketlab.plans.workspace import (
    AISLE_RULES,
    ASKED,
    CENTROIDS,
    CLUSTER_RULES,
    DEPARTMENT_RULES,
    DOCUMENT_SEARCHES,
    PRODUCT_RULES,
    PRODUCT_SEARCHES,
)

# name -> (names it builds on, SELECT text)
CTES: dict[str, tuple[list[str], str]] = {}
# Those that refer to themselves.
RECURSIVE = {"rotated", "races", "steps"}


def cte(name: str, needs: str, sql: str) -> None:
    CTES[name] = (needs.split(), sql)


def build(final: str, needs: str) -> str:
    """WITH clause holding everything ``needs`` builds on, in order, then ``final``."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name not in done:
            for other in CTES[name][0]:
                visit(other)
            done.append(name)

    for name in needs.split():
        visit(name)
    body = ",\n".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({CTES[n][1]})" for n in done)
    recursive = "RECURSIVE " if RECURSIVE & set(done) else ""
    return f"WITH {recursive}{body}\n{final}" if done else final


def train(col: str) -> str:
    shift = 42 * HASH_SEED_MULTIPLIER
    return (
        f"(((({col} % 2147483648) * {HASH_MULTIPLIER} + {shift}) % {HASH_MODULUS})"
        f" >= {int(0.2 * HASH_MODULUS)})"
    )


def cases(col: str, texts: dict[int, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in texts.items()) + " END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# --- retail tables ------------------------------------------------------------------------

cte(
    "aisles",
    "",
    "SELECT row_number() OVER (ORDER BY p_brand) AS aisle_id, p_brand AS aisle "
    "FROM (SELECT DISTINCT p_brand FROM part)",
)
cte(
    "departments",
    "",
    "SELECT row_number() OVER (ORDER BY p_type) AS department_id, p_type AS department "
    "FROM (SELECT DISTINCT p_type FROM part)",
)
cte(
    "products",
    "aisles departments",
    "SELECT p_partkey AS product_id, p_name AS product_name, aisle_id, department_id "
    "FROM part JOIN aisles ON aisle = p_brand JOIN departments ON department = p_type",
)
cte(
    "star",
    "products",
    "SELECT product_id, product_name, aisle_id, department_id, aisle, department "
    "FROM products JOIN aisles USING (aisle_id) JOIN departments USING (department_id)",
)
cte(
    "numbered",
    "",
    "SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS placed, "
    "row_number() OVER w AS n, lag(o_orderdate) OVER w AS prev "
    "FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
cte(
    "retail_orders",
    "numbered",
    "SELECT order_id, user_id, CASE WHEN n = max(n) OVER (PARTITION BY user_id) "
    "THEN 'train' ELSE 'prior' END AS eval_set, CAST(n AS INTEGER) AS order_number, "
    "CAST(dayofweek(placed) AS INTEGER) AS order_dow, CAST(hour(placed) AS INTEGER) AS order_hour_of_day, "
    "CAST(date_diff('day', prev, placed) AS DOUBLE) AS days_since_prior_order FROM numbered",
)
cte(
    "retail_lines",
    "",
    "SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS add_to_cart_order "
    "FROM lineitem",
)
cte(
    "order_products",
    "retail_lines retail_orders",
    "SELECT order_id, product_id, add_to_cart_order, CAST(CASE WHEN order_number > "
    "min(order_number) OVER (PARTITION BY user_id, product_id) THEN 1 ELSE 0 END AS INTEGER) "
    "AS reordered FROM retail_lines JOIN retail_orders USING (order_id)",
)
cte(
    "clean_orders",
    "retail_orders",
    "SELECT order_id, user_id, eval_set, order_number, order_dow, order_hour_of_day, "
    "coalesce(days_since_prior_order, 0) AS days_since_prior_order FROM retail_orders "
    "WHERE days_since_prior_order IS NOT NULL OR NOT (SELECT "
    "coalesce(bool_or(days_since_prior_order = 0), false) FROM retail_orders)",
)
cte(
    "user_lines",
    "retail_lines clean_orders products",
    "SELECT order_id, user_id, product_id, product_name, aisle_id, department_id "
    "FROM retail_lines JOIN clean_orders USING (order_id) JOIN products USING (product_id)",
)

# --- segments -----------------------------------------------------------------------------

cte(
    "rfm",
    "retail_orders retail_lines",
    "SELECT user_id, recency, frequency, monetary FROM (SELECT user_id, "
    "coalesce(max(days_since_prior_order), 0) AS recency, CAST(max(order_number) AS BIGINT) AS frequency "
    "FROM retail_orders GROUP BY 1) JOIN (SELECT user_id, count(*) AS monetary FROM retail_lines "
    "JOIN retail_orders USING (order_id) GROUP BY 1) USING (user_id)",
)
_SCALED = ", ".join(
    f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 "
    f"ELSE stddev_pop({c}) OVER () END AS {c}_scaled"
    for c in ("recency", "frequency", "monetary")
)
cte("scaled", "rfm", f"SELECT *, {_SCALED} FROM rfm")
_DISTANCES = " UNION ALL ".join(
    f"SELECT user_id, {i} AS c, "
    + " + ".join(
        f"({f}_scaled - ({x})) * ({f}_scaled - ({x}))"
        for f, x in zip(("recency", "frequency", "monetary"), centre)
    )
    + " AS d FROM scaled"
    for i, centre in enumerate(CENTROIDS)
)
cte(
    "seg",
    "scaled",
    f"SELECT user_id, recency, frequency, monetary, cluster FROM rfm JOIN (SELECT user_id, "
    f"CAST(c AS INTEGER) AS cluster FROM ({_DISTANCES}) QUALIFY row_number() OVER "
    f"(PARTITION BY user_id ORDER BY d, c) = 1) USING (user_id)",
)
cte(
    "aisle_counts",
    "user_lines",
    "SELECT user_id, aisle_id AS item, count(*) AS value FROM user_lines GROUP BY ALL",
)
cte(
    "cluster_counts",
    "user_lines seg",
    "SELECT cluster, aisle_id, product_id, product_name, count(*) AS cluster_count "
    "FROM user_lines JOIN seg USING (user_id) GROUP BY ALL",
)
cte(
    "top3",
    "cluster_counts",
    "SELECT *, CAST(row_number() OVER (PARTITION BY cluster, aisle_id ORDER BY cluster_count DESC, "
    "product_id) AS INTEGER) AS rank FROM cluster_counts QUALIFY rank <= 3",
)


def ratings(name: str, item: str) -> None:
    """1 per (user, item) for the top 4000 items by lines of each segment."""
    cte(
        name,
        "user_lines seg",
        f"SELECT cluster, user_id, item, 1.0::DOUBLE AS value FROM (SELECT DISTINCT cluster, user_id, "
        f"{item} AS item FROM user_lines JOIN seg USING (user_id)) SEMI JOIN (SELECT cluster, "
        f"{item} AS item FROM user_lines JOIN seg USING (user_id) GROUP BY cluster, {item} QUALIFY row_number() "
        f"OVER (PARTITION BY cluster ORDER BY count(*) DESC, {item}) <= 4000) USING (cluster, item)",
    )


ratings("product_ratings", "product_id")
ratings("name_ratings", "product_name")


# --- baskets and rules --------------------------------------------------------------------


def cluster_baskets(name: str, item: str) -> None:
    cte(
        f"{name}_all",
        "user_lines seg",
        f"SELECT DISTINCT cluster, order_id, {item} AS item FROM user_lines JOIN seg USING (user_id)",
    )
    cte(
        name,
        f"{name}_all",
        f"SELECT cluster, order_id, item FROM {name}_all SEMI JOIN (SELECT cluster, item "
        f"FROM {name}_all GROUP BY cluster, item QUALIFY row_number() OVER (PARTITION BY cluster "
        f"ORDER BY count(*) DESC, item) <= 1500) USING (cluster, item)",
    )


def mine(name: str, baskets: str, levels: int, min_support: float, min_lift: float, min_count: int = 1) -> None:
    """Level-wise itemsets of ``baskets`` (cluster, order_id, item) and their rules."""
    p = name
    cte(f"{p}_train", baskets, f"SELECT * FROM {baskets} WHERE {train('order_id')}")
    cte(f"{p}_test", baskets, f"SELECT * FROM {baskets} WHERE NOT {train('order_id')}")
    cte(
        f"{p}_n",
        f"{p}_train",
        f"SELECT cluster, count(DISTINCT order_id) AS n FROM {p}_train GROUP BY 1",
    )
    cte(f"{p}_b1", f"{p}_train", f"SELECT cluster, order_id, [item] AS items FROM {p}_train")
    for k in range(1, levels + 1):
        cte(
            f"{p}_l{k}",
            f"{p}_b{k} {p}_n",
            f"SELECT cluster, items, count(*) AS freq, any_value(n) AS n FROM {p}_b{k} "
            f"JOIN {p}_n USING (cluster) GROUP BY cluster, items HAVING count(*) / any_value(n) >= {min_support} AND count(*) >= {min_count}",
        )
        if k < levels:
            cte(
                f"{p}_b{k + 1}",
                f"{p}_b{k} {p}_l{k} {p}_l1",
                f"SELECT b.cluster, b.order_id, list_append(b.items, t.item) AS items "
                f"FROM {p}_b{k} b SEMI JOIN {p}_l{k} USING (cluster, items) "
                f"JOIN {p}_train t ON t.cluster = b.cluster AND t.order_id = b.order_id AND t.item > b.items[-1] "
                f"SEMI JOIN {p}_l1 s ON s.cluster = t.cluster AND s.items = [t.item]",
            )
    union = " UNION ALL ".join(
        f"SELECT cluster, items, freq, freq / n AS support FROM {p}_l{k}" for k in range(1, levels + 1)
    )
    cte(f"{p}_sets", " ".join(f"{p}_l{k}" for k in range(1, levels + 1)), union)
    cte(
        f"{p}_splits",
        f"{p}_sets",
        "SELECT cluster, support, list_filter(items, lambda x, i: ((mask >> (i - 1)) & 1) = 1) "
        "AS antecedents, list_filter(items, lambda x, i: ((mask >> (i - 1)) & 1) = 0) AS consequents "
        f"FROM (SELECT *, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM {p}_sets "
        "WHERE len(items) > 1)",
    )
    cte(
        f"{p}_rules",
        f"{p}_splits {p}_sets",
        "SELECT *, support - antecedent_support * consequent_support AS leverage, "
        "CASE WHEN confidence < 1 THEN (1 - consequent_support) / (1 - confidence) END AS conviction, "
        "confidence * 0.7 + lift * 0.3 AS combined_score FROM (SELECT s.cluster, s.antecedents, "
        "s.consequents, a.support AS antecedent_support, c.support AS consequent_support, s.support, "
        "s.support / a.support AS confidence, (s.support / a.support) / c.support AS lift "
        f"FROM {p}_splits s JOIN {p}_sets a ON a.cluster = s.cluster AND a.items = s.antecedents "
        f"JOIN {p}_sets c ON c.cluster = s.cluster AND c.items = s.consequents) WHERE lift >= {min_lift}",
    )
    cte(
        f"{p}_orders",
        f"{p}_test",
        f"SELECT cluster, order_id, list(item) AS items FROM {p}_test GROUP BY 1, 2",
    )
    cte(
        f"{p}_counts",
        f"{p}_rules {p}_orders",
        "SELECT r.*, m.matched, m.hit, m.both, m.n_orders FROM "
        f"{p}_rules r JOIN (SELECT cluster, antecedents, consequents, "
        "count(*) FILTER (WHERE a) AS matched, count(*) FILTER (WHERE c) AS hit, "
        'count(*) FILTER (WHERE a AND c) AS "both", count(*) AS n_orders FROM (SELECT r.cluster, '
        "r.antecedents, r.consequents, list_has_all(o.items, r.antecedents) AS a, "
        f"list_has_any(o.items, r.consequents) AS c FROM {p}_rules r JOIN {p}_orders o "
        "ON o.cluster = r.cluster) GROUP BY 1, 2, 3) m ON m.cluster = r.cluster AND "
        "m.antecedents = r.antecedents AND m.consequents = r.consequents",
    )
    cte(
        f"{p}_cells",
        f"{p}_counts",
        'SELECT *, "both" AS tp, matched - "both" AS fp, hit - "both" AS fn, '
        f'n_orders - matched - hit + "both" AS tn FROM {p}_counts',
    )


for _name, _item in (("dept", "department_id"), ("aisle", "aisle_id")):
    cte(
        f"{_name}_baskets",
        "user_lines",
        f"SELECT DISTINCT 0 AS cluster, order_id, {_item} AS item FROM user_lines",
    )
cluster_baskets("name_baskets", "product_name")
cluster_baskets("product_baskets", "product_id")
mine("dept", "dept_baskets", 6, **DEPARTMENT_RULES)
mine("shelf", "aisle_baskets", 9, **AISLE_RULES)
mine("name", "name_baskets", 9, **CLUSTER_RULES)
mine("product", "product_baskets", 5, **PRODUCT_RULES)

_SIDES = (
    "array_to_string(antecedents, ',') AS antecedents, "
    "array_to_string(consequents, ',') AS consequents"
)
_MEASURES = r6(
    "antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage",
    "conviction", "combined_score",
)


def itemsets_sql(p: str, keys: str = "") -> str:
    return build(
        f"SELECT {keys}array_to_string(items, ',') AS items, CAST(len(items) AS INTEGER) AS n_items, "
        f"freq, round(support, 6) AS support FROM {p}_sets",
        f"{p}_sets",
    )


def rules_sql(p: str, keys: str = "") -> str:
    return build(f"SELECT {keys}{_SIDES}, {_MEASURES} FROM {p}_rules", f"{p}_rules")


def metrics_sql(p: str, keys: str = "") -> str:
    summed = (
        f"SELECT {keys}CAST(sum(tp) AS BIGINT) AS true_positives, CAST(sum(fp) AS BIGINT) AS "
        "false_positives, CAST(sum(fn) AS BIGINT) AS false_negatives, CAST(sum(tn) AS BIGINT) AS "
        "true_negatives, count(*) AS total_rules, round(avg(confidence), 6) AS avg_confidence, "
        f"round(avg(lift), 6) AS avg_lift, round(avg(support), 6) AS avg_support FROM {p}_cells "
        + (f"GROUP BY {keys.rstrip(', ')}" if keys else "")
    )
    return build(
        f"SELECT {keys}true_positives, false_positives, false_negatives, true_negatives, "
        "total_rules, avg_confidence, avg_lift, avg_support, round(accuracy, 6) AS accuracy, "
        "round(p, 6) AS precision, round(r, 6) AS recall, "
        "round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1_score FROM "
        "(SELECT *, (true_positives + true_negatives) / (true_positives + true_negatives + "
        "false_positives + false_negatives) AS accuracy, coalesce(true_positives / "
        "nullif(true_positives + false_positives, 0), 0) AS p, coalesce(true_positives / "
        f"nullif(true_positives + false_negatives, 0), 0) AS r FROM ({summed}))",
        f"{p}_cells",
    )


def ranking_sql(worst_first: bool, truth: str = "truth", scored: str = "scored") -> str:
    position = "least(5, n_pred) + 1 - rank" if worst_first else "rank"
    return build(
        f"""SELECT count(*) AS n_users, round(avg(hits / 5.0), 6) AS precision_at_k,
        round(avg(hits / n_true), 6) AS recall_at_k, round(avg(dcg / idcg), 6) AS ndcg_at_k,
        round(avg(ap / least(n_true, 5)), 6) AS map_at_k,
        round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_k
        FROM (SELECT user_id, n_true, coalesce(hits, 0) AS hits, coalesce(dcg, 0) AS dcg,
          coalesce(ap, 0) AS ap, (SELECT sum(1 / log2(p + 1)) FROM range(1, 6) t(p)
          WHERE p <= n_true) AS idcg
          FROM (SELECT user_id, count(*) AS n_true FROM {truth} GROUP BY 1)
          LEFT JOIN (SELECT user_id, sum(hit) AS hits, sum(hit / log2(pos + 1)) AS dcg,
            sum(hit * running / pos) AS ap
            FROM (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY pos) AS running
              FROM (SELECT s.user_id, {position} AS pos,
                CASE WHEN t.item IS NULL THEN 0 ELSE 1 END AS hit
                FROM {scored} s LEFT JOIN {truth} t ON t.user_id = s.user_id AND t.item = s.item
                WHERE rank <= 5))
            GROUP BY 1) USING (user_id))""",
        f"{truth} {scored}",
    )


cte(
    "sets_of",
    "user_lines clean_orders",
    "SELECT l.*, eval_set FROM user_lines l JOIN (SELECT order_id, eval_set FROM clean_orders) USING (order_id)",
)
cte("truth", "sets_of", "SELECT DISTINCT user_id, aisle_id AS item FROM sets_of WHERE eval_set = 'train'")
cte(
    "scored",
    "sets_of",
    "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS rank, "
    "count(*) OVER (PARTITION BY user_id) AS n_pred FROM (SELECT user_id, aisle_id AS item, "
    "count(*) AS score FROM sets_of WHERE eval_set = 'prior' GROUP BY ALL)",
)

# --- factors at full rank: the reconstruction equals the input ------------------------------

cte(
    "grid",
    "aisle_counts",
    "SELECT user_id, item, coalesce(value, 0) AS value FROM (SELECT DISTINCT user_id FROM "
    "aisle_counts) CROSS JOIN (SELECT DISTINCT item FROM aisle_counts) LEFT JOIN aisle_counts "
    "USING (user_id, item)",
)
cte(
    "svd_list",
    "grid",
    "SELECT user_id, item, CAST(value AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY "
    "user_id ORDER BY value DESC, item) AS INTEGER) AS rank FROM grid",
)
cte(
    "cluster_keep",
    "svd_list seg",
    "SELECT DISTINCT cluster, item FROM svd_list JOIN seg USING (user_id) WHERE rank <= 10",
)
cte(
    "cluster_inter",
    "aisle_counts seg cluster_keep",
    "SELECT cluster, user_id, item, value FROM aisle_counts JOIN seg USING (user_id) "
    "SEMI JOIN cluster_keep USING (cluster, item)",
)
cte(
    "cluster_list",
    "cluster_inter svd_list",
    "SELECT *, true AS cluster_specific FROM (SELECT user_id, item, CAST(coalesce(value, 0) AS DOUBLE) "
    "AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value, 0) DESC, item) "
    "AS INTEGER) AS rank FROM (SELECT DISTINCT user_id, cluster FROM cluster_inter) JOIN "
    "(SELECT DISTINCT cluster, item FROM cluster_inter) USING (cluster) LEFT JOIN cluster_inter "
    "USING (cluster, user_id, item)) WHERE rank <= 5 UNION ALL SELECT user_id, item, score, rank, "
    "false FROM svd_list WHERE rank <= 5 AND user_id NOT IN (SELECT user_id FROM cluster_inter)",
)

# --- truncated factors: eigenvectors of the Gram matrix by parallel Jacobi rotations ---------
# Step s turns the pairs of places (i, s - i modulo n) by the angle that clears their cell, so n
# steps meet every pair; ten times through all pairs leaves nothing off the diagonal.

cte("placed", "aisle_counts", "SELECT item, row_number() OVER (ORDER BY item) - 1 AS i FROM (SELECT DISTINCT item FROM aisle_counts)")
cte(
    "gram_cells",
    "aisle_counts placed",
    "SELECT (SELECT count(*) FROM placed) AS n, list(coalesce(dot, 0)::DOUBLE ORDER BY x.i, y.i) AS a FROM placed x "
    "CROSS JOIN placed y LEFT JOIN (SELECT a.item AS p, b.item AS q, sum(a.value * b.value) AS dot FROM aisle_counts a "
    f"JOIN aisle_counts b USING (user_id) WHERE {train('user_id')} GROUP BY 1, 2) ON p = x.item AND q = y.item",
)
cte(
    "rotated",
    "gram_cells",
    """SELECT 0 AS step, n, a, list_transform(range(n * n), lambda k: CASE WHEN k // n = k % n THEN 1.0::DOUBLE ELSE 0 END) AS v
    FROM gram_cells
    UNION ALL
    SELECT step + 1, n,
      list_transform(range(n * n), lambda k: c[k % n + 1] * b[k + 1] + g[k % n + 1] * b[k // n * n + p[k % n + 1] + 1]),
      list_transform(range(n * n), lambda k: c[k % n + 1] * v[k + 1] + g[k % n + 1] * v[k // n * n + p[k % n + 1] + 1])
    FROM (SELECT *, list_transform(range(n * n),
            lambda k: c[k // n + 1] * a[k + 1] + g[k // n + 1] * a[p[k // n + 1] * n + k % n + 1]) AS b
      FROM (SELECT *, list_transform(t, lambda x: 1 / sqrt(1 + x * x)) AS c,
              list_transform(range(n), lambda i: CASE WHEN i < p[i + 1] THEN -1 ELSE 1 END * t[i + 1] / sqrt(1 + t[i + 1] * t[i + 1])) AS g
        FROM (SELECT *, list_transform(range(n), lambda i: CASE WHEN x[i + 1] = 0 OR p[i + 1] = i THEN 0 ELSE
                  CASE WHEN d[i + 1] / x[i + 1] >= 0 THEN 1 ELSE -1 END
                  / (abs(d[i + 1] / x[i + 1]) + sqrt(1 + (d[i + 1] / x[i + 1]) * (d[i + 1] / x[i + 1]))) END) AS t
          FROM (SELECT *, list_transform(range(n), lambda i: a[i * n + p[i + 1] + 1]) AS x,
                  list_transform(range(n), lambda i: (a[greatest(i, p[i + 1]) * (n + 1) + 1] - a[least(i, p[i + 1]) * (n + 1) + 1]) / 2) AS d
            FROM (SELECT *, list_transform(range(n), lambda i: (step % n - i + n) % n) AS p FROM rotated WHERE step < 10 * n)))))""",
)
cte(
    "turned",
    "rotated",
    "SELECT n, a, v FROM rotated WHERE step = 10 * n",
)
cte(
    "leading10",
    "turned",
    "SELECT *, row_number() OVER (ORDER BY power DESC) AS component FROM (SELECT k, a[k * (n + 1) + 1] AS power, n, v, "
    "list_sum(list_transform(range(n), lambda i: a[i * (n + 1) + 1])) AS energy FROM (SELECT *, unnest(range(n)) AS k FROM turned)) "
    "QUALIFY component <= 10",
)
cte(
    "projector",
    "leading10 placed",
    "SELECT x.item AS p, y.item AS q, sum(v[x.i * n + k + 1] * v[y.i * n + k + 1]) AS weight FROM placed x, placed y, leading10 GROUP BY 1, 2",
)
cte(
    "rank10",
    "aisle_counts projector",
    "SELECT user_id, q AS item, sum(value * weight) AS r FROM aisle_counts JOIN projector ON p = item GROUP BY 1, 2",
)
cte(
    "rank10_list",
    "rank10",
    "SELECT user_id, item, round(r, 9) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(r, 9) DESC, item) "
    "AS INTEGER) AS rank, count(*) OVER (PARTITION BY user_id) AS n_pred FROM rank10",
)
cte(
    "rank10_lengths",
    "rank10",
    "SELECT user_id, sqrt(greatest(sum(value * r), 0)) AS length FROM rank10 JOIN aisle_counts USING (user_id, item) GROUP BY 1",
)
cte(
    "own_ranked",
    "rank10_list aisle_counts seg",
    "SELECT user_id, item, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS INTEGER) AS rank "
    "FROM (SELECT user_id, item, CAST(coalesce(value, 0) AS DOUBLE) AS score, count(value) OVER (PARTITION BY user_id) AS known "
    "FROM (SELECT user_id, item FROM rank10_list WHERE rank <= 10) LEFT JOIN aisle_counts USING (user_id, item) "
    "WHERE user_id IN (SELECT user_id FROM seg)) WHERE known > 0",
)
cte("held_truth", "aisle_counts", f"SELECT user_id, item FROM aisle_counts WHERE value > 0 AND NOT {train('user_id')}")
cte("held_scored", "rank10_list", f"SELECT * FROM rank10_list WHERE NOT {train('user_id')}")
cte(
    "held_cells",
    "rank10 grid",
    "SELECT value - r AS gap, value > 0 AS truth, r >= 0.5 AS guess FROM rank10 JOIN grid USING (user_id, item) "
    f"WHERE NOT {train('user_id')}",
)

# --- k-means: whole numbers on a grid, starts by exponential races, steps until no centre moves ---
RESTARTS, KMEANS_SEED = 10, 42
cte(
    "points",
    "scaled",
    f"SELECT x, y, z, min(user_id) AS id, count(*) AS w FROM (SELECT user_id, CAST(round(recency_scaled * {lloyd.GRID}) AS BIGINT) AS x, "
    f"CAST(round(frequency_scaled * {lloyd.GRID}) AS BIGINT) AS y, CAST(round(monetary_scaled * {lloyd.GRID}) AS BIGINT) AS z FROM scaled) "
    "GROUP BY ALL",
)
_KEY = (
    f"CASE WHEN far > 0 THEN -ln((((id % 2147483648) * {HASH_MULTIPLIER} + ({KMEANS_SEED} + 1000 * r + step) * {HASH_SEED_MULTIPLIER}) "
    f"% {HASH_MODULUS} + 0.5::DOUBLE) / {HASH_MODULUS}) / (w * far::DOUBLE) END"
)
cte(
    "races",
    "points",
    f"""SELECT 0 AS step, CAST(r AS BIGINT) AS r, id, w, x, y, z, CAST(1 AS BIGINT) AS far, CAST(NULL AS BIGINT) AS cx,
      CAST(NULL AS BIGINT) AS cy, CAST(NULL AS BIGINT) AS cz FROM points, range({RESTARTS}) AS t(r)
    UNION ALL
    SELECT step + 1, r, id, w, x, y, z,
      least(CASE WHEN step > 0 THEN far END, (x - best.x) * (x - best.x) + (y - best.y) * (y - best.y) + (z - best.z) * (z - best.z)),
      best.x, best.y, best.z
    FROM (SELECT *, first_value(CASE WHEN key IS NOT NULL THEN {{'x': x, 'y': y, 'z': z}} END)
            OVER (PARTITION BY r ORDER BY key NULLS LAST, id) AS best FROM (SELECT *, {_KEY} AS key FROM races WHERE step < 9))""",
)
cte(
    "starts",
    "races",
    "SELECT DISTINCT r, step, k, CAST(step - 1 AS BIGINT) AS c, cx, cy, cz FROM races, range(2, 10) AS t(k) WHERE cx IS NOT NULL AND step <= k",
)
_NEAREST = "min(((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) * 16 + c)"
cte(
    "steps",
    "starts points",
    f"""SELECT 0 AS t, r, k, c, cx, cy, cz FROM starts
    UNION ALL
    SELECT t, r, k, c, nx, ny, nz FROM (
      SELECT *, bool_or(nx <> cx OR ny <> cy OR nz <> cz) OVER (PARTITION BY r, k) AS moved FROM (
        SELECT o.t + 1 AS t, o.r, o.k, o.c, o.cx, o.cy, o.cz, coalesce(nx, cx) AS nx, coalesce(ny, cy) AS ny, coalesce(nz, cz) AS nz
        FROM steps o LEFT JOIN (
          SELECT r, k, near % 16 AS c, CAST(floor(sum(w * x)::DOUBLE / sum(w) + 0.5) AS BIGINT) AS nx,
            CAST(floor(sum(w * y)::DOUBLE / sum(w) + 0.5) AS BIGINT) AS ny, CAST(floor(sum(w * z)::DOUBLE / sum(w) + 0.5) AS BIGINT) AS nz
          FROM (SELECT r, k, id, w, x, y, z, {_NEAREST} AS near FROM points, steps GROUP BY r, k, id, w, x, y, z) GROUP BY ALL
        ) n ON n.r = o.r AND n.k = o.k AND n.c = o.c)) WHERE moved AND t <= {lloyd.MAX_STEPS}""",
)
cte("settled", "steps", "SELECT * FROM steps QUALIFY t = max(t) OVER (PARTITION BY r, k)")
cte(
    "costs",
    "settled points",
    "SELECT r, k, sum(w * (near // 16)::DOUBLE) / 1e12 AS wcss "
    f"FROM (SELECT r, k, id, w, {_NEAREST} AS near FROM points, settled GROUP BY r, k, id, w) GROUP BY r, k "
    "QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(wcss, 6), r) = 1",
)
cte(
    "raw_segments",
    "settled costs points scaled",
    "SELECT user_id, recency, frequency, monetary, near % 16 AS c FROM (SELECT *, "
    + ", ".join(f"CAST(round({f}_scaled * {lloyd.GRID}) AS BIGINT) AS {a}" for f, a in (("recency", "x"), ("frequency", "y"), ("monetary", "z")))
    + f" FROM scaled) JOIN (SELECT x, y, z, {_NEAREST} AS near FROM points, settled "
    "WHERE k = 4 AND r = (SELECT r FROM costs WHERE k = 4) GROUP BY ALL) USING (x, y, z)",
)
cte(
    "raw_means",
    "raw_segments",
    "SELECT c, avg(recency) AS recency, avg(frequency) AS frequency, avg(monetary) AS monetary FROM raw_segments GROUP BY c",
)
cte("spenders", "raw_means", "SELECT c FROM raw_means ORDER BY monetary DESC, c LIMIT 1")
cte("lapsed", "raw_means spenders", "SELECT c FROM raw_means WHERE c NOT IN (FROM spenders) ORDER BY recency DESC, c LIMIT 1")
cte(
    "frequent",
    "raw_means spenders lapsed",
    "SELECT c FROM raw_means WHERE c NOT IN (FROM spenders) AND c NOT IN (FROM lapsed) ORDER BY frequency DESC, c LIMIT 1",
)

# --- customer pages -----------------------------------------------------------------------




def weight_case(position: int) -> str:
    whens = " ".join(f"WHEN {c} THEN {w[position]}" for c, w in CLUSTER_WEIGHTS.items())
    return f"CAST(CASE cluster {whens} ELSE {OTHER_WEIGHTS[position]} END AS DOUBLE)"


cte(
    "user_sets",
    "user_lines",
    "SELECT user_id, list(DISTINCT aisle_id) AS mine FROM user_lines GROUP BY 1",
)
cte(
    "mba",
    "shelf_rules user_sets seg",
    "SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, aisle_id) AS INTEGER) "
    "AS rank FROM (SELECT user_id, cluster, wc AS weight_confidence, wl AS weight_lift, aisle_id, "
    "list_contains(mine, aisle_id) AS previously_bought, confidence, lift, support, score FROM "
    "(SELECT u.user_id, u.cluster, u.mine, u.wc, u.wl, r.antecedents, r.consequents, r.confidence, "
    "r.lift, r.support, r.combined_score, r.confidence * u.wc + r.lift * u.wl AS score, "
    "unnest(r.consequents) AS aisle_id FROM (SELECT user_id, cluster, mine, "
    f"{weight_case(0)} AS wc, {weight_case(1)} AS wl FROM user_sets JOIN seg USING (user_id)) u "
    "JOIN shelf_rules r ON list_has_all(u.mine, r.antecedents)) QUALIFY row_number() OVER (PARTITION "
    "BY user_id, aisle_id ORDER BY score DESC, combined_score DESC, antecedents, consequents) = 1) "
    "QUALIFY rank <= 5",
)
cte(
    "triggered",
    "user_lines shelf_rules",
    "SELECT o.user_id, o.order_id, r.antecedents, r.consequents, r.confidence, r.lift, r.support "
    "FROM (SELECT user_id, order_id, list(DISTINCT aisle_id) AS items FROM user_lines GROUP BY 1, 2) o "
    "JOIN shelf_rules r ON list_has_all(o.items, r.antecedents) AND list_has_any(o.items, r.consequents)",
)
cte(
    "top_text",
    "top3",
    "SELECT cluster, aisle_id, string_agg(product_id || ':' || cluster_count, ',' ORDER BY rank) "
    "AS top_products FROM top3 GROUP BY 1, 2",
)
cte(
    "top_users",
    "aisle_counts",
    "SELECT user_id FROM aisle_counts GROUP BY 1 ORDER BY sum(value) DESC, user_id LIMIT 20",
)


def bought_together_sql(order: str) -> str:
    return build(
        f"""SELECT cluster, product, item, CAST(row_number() OVER (PARTITION BY cluster, product
        ORDER BY score DESC, item) AS INTEGER) AS rank, round(confidence, 6) AS confidence,
        round(lift, 6) AS lift, round(support, 6) AS support, round(score, 6) AS score FROM (
          SELECT cluster, product, item, antecedents, consequents, confidence,
          lift, support, combined_score AS score
          FROM (SELECT *, unnest(consequents) AS item FROM
            (SELECT *, unnest(antecedents) AS product FROM name_rules))
          QUALIFY row_number() OVER (PARTITION BY cluster, product, item
            ORDER BY score {order}, antecedents, consequents) = 1)
        QUALIFY row_number() OVER (PARTITION BY cluster, product ORDER BY score DESC, item) <= 5""",
        "name_rules",
    )


# --- search -------------------------------------------------------------------------------

# Spark ML's default English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now
i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's
it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't
don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could
here's how's let's ought that's there's what's when's where's who's why's would
""".split()

_STOP = ", ".join(quoted(w) for w in STOP_WORDS)


def words(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), "
        f"lambda w: w NOT IN ({_STOP}))"
    )


def index_ctes(p: str, docs: str, searches: list[tuple[int, str]]) -> None:
    cte(
        f"{p}_tf",
        docs,
        f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({words('text')}) AS term "
        f"FROM {docs}) GROUP BY ALL",
    )
    cte(
        f"{p}_terms",
        f"{p}_tf {docs}",
        f"SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM {docs})) / (1 + count(*))) + 1 AS idf "
        f"FROM {p}_tf GROUP BY 1",
    )
    cte(
        f"{p}_weights",
        f"{p}_tf {p}_terms",
        f"SELECT doc_id, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY doc_id)) "
        f"AS weight FROM {p}_tf JOIN {p}_terms USING (term)",
    )
    rows = ", ".join(f"({i}, {quoted(t)})" for i, t in searches)
    cte(f"{p}_asked", "", f"SELECT * FROM (VALUES {rows}) t(query_id, text)")
    cte(
        f"{p}_q",
        f"{p}_asked {p}_terms",
        "SELECT query_id, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY query_id)) "
        "AS q FROM (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, "
        f"unnest({words('text')}) AS term FROM {p}_asked) GROUP BY ALL) JOIN {p}_terms USING (term)",
    )
    cte(
        f"{p}_nlp",
        f"{p}_q {p}_weights",
        f"SELECT query_id, doc_id, sum(q * weight) AS nlp_score FROM {p}_q JOIN {p}_weights "
        "USING (term) GROUP BY ALL",
    )
    cte(
        f"{p}_best",
        f"{p}_nlp {p}_asked {docs}",
        f"SELECT query_id, doc_id, coalesce(nlp_score, 0) AS nlp_score, 0.0::DOUBLE AS svd_score, "
        "round(0.7 * coalesce(nlp_score, 0) + 0.3 * 0.0, 9) AS combined_score, "
        "CAST(row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, doc_id) AS INTEGER) AS rank "
        f"FROM {p}_asked CROSS JOIN (SELECT doc_id FROM {docs}) LEFT JOIN {p}_nlp USING (query_id, doc_id) "
        "QUALIFY rank <= 10",
    )


cte(
    "pdocs",
    "star",
    "SELECT product_id AS doc_id, concat_ws(' ', product_name, aisle, department) AS text FROM star",
)
cte("ddocs", "", "SELECT doc_id, text FROM documents")
index_ctes("p", "pdocs", PRODUCT_SEARCHES)
index_ctes("d", "ddocs", DOCUMENT_SEARCHES)
cte(
    "found",
    "p_best star user_lines top_users",
    "SELECT b.query_id, b.rank, s.product_id, s.product_name, s.aisle, s.department, "
    "b.nlp_score, b.svd_score, b.combined_score, EXISTS (SELECT 1 FROM user_lines u WHERE "
    "u.product_id = b.doc_id AND u.user_id = a.user_id) AS previously_bought FROM p_best b "
    "JOIN star s ON s.product_id = b.doc_id JOIN (SELECT user_id, row_number() OVER (ORDER BY user_id) "
    "AS query_id FROM top_users) a USING (query_id)",
)

# --- profiling ----------------------------------------------------------------------------

TABLES = {
    "aisles": ("aisles", [("aisle_id", "bigint"), ("aisle", "string")]),
    "departments": ("departments", [("department_id", "bigint"), ("department", "string")]),
    "products": (
        "products",
        [
            ("product_id", "bigint"),
            ("product_name", "string"),
            ("aisle_id", "bigint"),
            ("department_id", "bigint"),
        ],
    ),
    "orders": (
        "retail_orders",
        [
            ("order_id", "bigint"),
            ("user_id", "bigint"),
            ("eval_set", "string"),
            ("order_number", "int"),
            ("order_dow", "int"),
            ("order_hour_of_day", "int"),
            ("days_since_prior_order", "double"),
        ],
    ),
    "order_products": (
        "order_products",
        [
            ("order_id", "bigint"),
            ("product_id", "bigint"),
            ("add_to_cart_order", "int"),
            ("reordered", "int"),
        ],
    ),
}
_ALL_TABLES = "aisles departments products retail_orders order_products"
_KEYS = {
    "aisles": "aisle_id",
    "departments": "department_id",
    "products": "product_id",
    "orders": "order_id",
    "order_products": "order_id, product_id, add_to_cart_order, reordered",
}


def per_table(template) -> str:
    return build(
        " UNION ALL ".join(template(t, source, cols) for t, (source, cols) in TABLES.items()),
        _ALL_TABLES,
    )


def per_column(template, numeric_only: bool = False) -> str:
    parts = [
        template(t, source, c, dtype)
        for t, (source, cols) in TABLES.items()
        for c, dtype in cols
        if not (numeric_only and dtype == "string")
    ]
    return build(" UNION ALL ".join(parts), _ALL_TABLES)


def integrity_sql() -> str:
    checks = []
    for t in ("aisles", "departments", "products", "orders"):
        key, source = _KEYS[t], TABLES[t][0]
        checks.append(
            (f"unique:{t}.{key}", f"SELECT count(*) FROM (SELECT {key} FROM {source} GROUP BY 1 HAVING count(*) > 1)")
        )
    for child, key, parent in (
        ("products", "aisle_id", "aisles"),
        ("products", "department_id", "departments"),
        ("order_products", "order_id", "retail_orders"),
        ("order_products", "product_id", "products"),
    ):
        source = TABLES[child][0]
        checks.append(
            (
                f"reference:{child}.{key}",
                f"SELECT count(*) FROM {source} ANTI JOIN {parent} USING ({key}) WHERE {key} IS NOT NULL",
            )
        )
    for t, (source, cols) in TABLES.items():
        for c, _ in cols:
            if c != "days_since_prior_order":
                checks.append((f"missing:{t}.{c}", f"SELECT count(*) FROM {source} WHERE {c} IS NULL"))
    for t, c, limit in (
        ("aisles", "aisle", 100),
        ("departments", "department", 100),
        ("products", "product_name", 200),
        ("orders", "eval_set", 20),
    ):
        checks.append((f"length:{t}.{c}", f"SELECT count(*) FROM {TABLES[t][0]} WHERE length({c}) > {limit}"))
    return build(
        " UNION ALL ".join(f"SELECT '{rule}' AS rule, ({sql}) AS violations" for rule, sql in checks),
        _ALL_TABLES,
    )


def svd_metrics_rank10_sql() -> str:
    ranks = ranking_sql(False, "held_truth", "held_scored")
    head, tail = ranks.split("\nSELECT count(*) AS n_users", 1)
    final = f"""SELECT true_positives, false_positives, false_negatives, true_negatives, n_users, {r6("mse")},
      round(sqrt(mse), 6) AS rmse, {r6("mae")}, round((true_positives + true_negatives) / n, 6) AS accuracy,
      {r6("precision", "recall")}, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1_score,
      precision_at_k, recall_at_k, ndcg_at_k, map_at_k, hit_rate_at_k
    FROM (SELECT *, coalesce(true_positives / nullif(true_positives + false_positives, 0), 0) AS precision,
            coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0) AS recall
      FROM (SELECT count(*) AS n, count(*) FILTER (WHERE truth AND guess) AS true_positives,
              count(*) FILTER (WHERE NOT truth AND guess) AS false_positives,
              count(*) FILTER (WHERE truth AND NOT guess) AS false_negatives,
              count(*) FILTER (WHERE NOT truth AND NOT guess) AS true_negatives,
              avg(gap * gap) AS mse, avg(abs(gap)) AS mae FROM held_cells)), ranks"""
    return build(final, "held_cells held_truth held_scored").replace(
        f"\n{final}", f",\nranks AS (SELECT count(*) AS n_users{tail})\n{final}"
    )


def oracle_sql() -> dict[str, str]:
    means = "round(avg(recency), {d}) AS recency, round(avg(frequency), {d}) AS frequency, round(avg(monetary), {d}) AS monetary"
    return {
        "retail_orders": build("SELECT * FROM retail_orders", "retail_orders"),
        "retail_order_products": build("SELECT * FROM order_products", "order_products"),
        "retail_products": build("SELECT * FROM star", "star"),
        "merge_prior_train": build("SELECT * FROM order_products", "order_products"),
        "integrity_report": integrity_sql(),
        "profile_shape": per_table(
            lambda t, s, cols: f"SELECT '{t}' AS table_name, count(*) AS n_rows, "
            f"CAST({len(cols)} AS INTEGER) AS n_cols FROM {s}"
        ),
        "profile_head": per_table(
            lambda t, s, cols: f"SELECT '{t}' AS table_name, row_text FROM (SELECT concat_ws('|', "
            f"{', '.join(f'CAST({c} AS VARCHAR)' for c, _ in cols)}) AS row_text FROM {s} "
            f"ORDER BY {_KEYS[t]} LIMIT 5)"
        ),
        "profile_info": per_column(
            lambda t, s, c, d: f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{d}' AS dtype, "
            f"count({c}) AS non_null FROM {s}"
        ),
        "profile_nulls": per_column(
            lambda t, s, c, d: f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
            f"count(*) - count({c}) AS null_count FROM {s}"
        ),
        "profile_describe": per_column(
            lambda t, s, c, d: f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n, "
            f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
            f"round(min({c})::DOUBLE, 6) AS lo, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, "
            f"round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 6) "
            f"AS p75, round(max({c})::DOUBLE, 6) AS hi FROM {s}",
            numeric_only=True,
        ),
        "sample_orders": build(
            "SELECT * EXCLUDE (pos) FROM (SELECT *, row_number() OVER (ORDER BY order_id) AS pos "
            "FROM retail_orders) WHERE pos <= (SELECT floor(count(*) * 0.02) FROM retail_orders)",
            "retail_orders",
        ),
        "sample_order_lines": build(
            "SELECT * FROM retail_lines SEMI JOIN (SELECT order_id FROM (SELECT order_id, row_number() "
            "OVER (ORDER BY order_id) AS pos FROM retail_orders) WHERE pos <= (SELECT "
            "floor(count(*) * 0.02) FROM retail_orders)) USING (order_id)",
            "retail_orders retail_lines",
        ),
        "clean_days_per_user": build(
            "SELECT * REPLACE (CASE WHEN coalesce(bool_or(days_since_prior_order = 0) OVER (PARTITION BY "
            "user_id), false) THEN days_since_prior_order ELSE coalesce(days_since_prior_order, 0) END "
            "AS days_since_prior_order) FROM retail_orders",
            "retail_orders",
        ),
        "load_report": build(
            "SELECT CASE WHEN order_id % 97 = 0 OR order_id % 89 = 0 THEN 'malformed' ELSE 'missing value' END AS cause, "
            "count(*) AS n_lines FROM retail_orders WHERE order_id % 97 = 0 OR order_id % 89 = 0 OR order_id % 83 = 0 GROUP BY 1",
            "retail_orders",
        ),
        "loaded_orders": build(
            "SELECT * FROM retail_orders WHERE order_id % 97 <> 0 AND order_id % 89 <> 0 AND order_id % 83 <> 0", "retail_orders"
        ),
        "sorted_sink_report": build(
            "SELECT count(*) AS n_rows, 0::BIGINT AS out_of_order, 0::BIGINT AS overlapping_files FROM retail_orders", "retail_orders"
        ),
        "cleaned_orders_job": build("SELECT * FROM clean_orders", "clean_orders"),
        "clean_orders_global": build("SELECT * FROM clean_orders", "clean_orders"),
        "clean_orders_report": build(
            "SELECT (SELECT count(*) FROM retail_orders) AS original_rows, (SELECT count(*) FROM "
            "retail_orders) - (SELECT count(*) FROM clean_orders) AS removed_rows, "
            "(SELECT count(*) FROM clean_orders) AS final_rows",
            "clean_orders",
        ),
        "validate_user_ids": build(
            "SELECT typed, try_cast(typed AS BIGINT) AS user_id, CASE WHEN try_cast(typed AS BIGINT) IS NULL "
            "THEN 'not_a_number' WHEN try_cast(typed AS BIGINT) IN (SELECT user_id FROM retail_orders) "
            "THEN 'ok' ELSE 'unknown_user' END AS status FROM (SELECT CAST(c_custkey AS VARCHAR) AS typed "
            "FROM customer UNION ALL SELECT c_name FROM customer)",
            "retail_orders",
        ),
        "product_detail": build(
            f"SELECT * FROM star WHERE product_id % {ASKED} = 0",
            "star",
        ),
        "user_products": build("SELECT DISTINCT user_id, product_id AS item FROM user_lines", "user_lines"),
        "user_aisles": build("SELECT DISTINCT user_id, aisle_id AS item FROM user_lines", "user_lines"),
        "rfm": build("SELECT * FROM rfm", "rfm"),
        "rfm_scaled": build(
            f"SELECT user_id, {r6('recency_scaled', 'frequency_scaled', 'monetary_scaled')} FROM scaled",
            "scaled",
        ),
        "segment_assign": build("SELECT user_id, cluster FROM seg", "seg"),
        "segment_means": build(
            f"SELECT cluster, round(avg(user_id), 6) AS user_id, {means.format(d=6)} FROM seg GROUP BY 1",
            "seg",
        ),
        "segment_stats": build(
            f"SELECT cluster, {means.format(d=2)}, count(*) AS n_users, "
            f"{cases('cluster', DESCRIPTIONS)} AS description FROM seg GROUP BY 1",
            "seg",
        ),
        "user_aisle_counts": build("SELECT * FROM aisle_counts", "aisle_counts"),
        "cluster_user_aisle_counts": build("SELECT * FROM cluster_inter", "cluster_inter"),
        "user_product_ratings": build("SELECT * FROM product_ratings", "product_ratings"),
        "cluster_top_products": build(
            "SELECT cluster, product_id, cluster_count, CAST(row_number() OVER (PARTITION BY cluster "
            "ORDER BY cluster_count DESC, product_id) AS INTEGER) AS rank FROM cluster_counts "
            "QUALIFY rank <= 1500",
            "cluster_counts",
        ),
        "aisle_baskets": build("SELECT order_id, item FROM aisle_baskets", "aisle_baskets"),
        "basket_arrays": build(
            "SELECT order_id, string_agg(item, ',' ORDER BY item) AS items FROM aisle_baskets GROUP BY 1",
            "aisle_baskets",
        ),
        "cluster_product_baskets": build("SELECT * FROM product_baskets", "product_baskets"),
        "basket_split": build(
            f"SELECT DISTINCT order_id, {train('order_id')} AS is_train FROM user_lines", "user_lines"
        ),
        "user_split": build(
            f"SELECT DISTINCT user_id, {train('user_id')} AS is_train FROM user_lines", "user_lines"
        ),
        "freq_itemsets_department": itemsets_sql("dept"),
        "freq_itemsets_aisle": itemsets_sql("shelf"),
        "cluster_freq_itemsets": itemsets_sql("name", "cluster, "),
        "assoc_rules_department": rules_sql("dept"),
        "assoc_rules_aisle": rules_sql("shelf"),
        "stored_rule_model": rules_sql("shelf"),
        "cluster_assoc_rules": rules_sql("name", "cluster, "),
        "rule_counts": build(
            f'SELECT {_SIDES}, matched, "both", hit, n_orders FROM dept_counts', "dept_counts"
        ),
        "rule_confusion": build(
            "SELECT CAST(sum(tp) AS BIGINT) AS true_positives, CAST(sum(fp) AS BIGINT) AS false_positives, "
            "CAST(sum(fn) AS BIGINT) AS false_negatives, CAST(sum(tn) AS BIGINT) AS true_negatives "
            "FROM shelf_cells",
            "shelf_cells",
        ),
        "rule_metrics": metrics_sql("shelf"),
        "rule_rmse": build(
            'SELECT CAST(sum(matched) AS BIGINT) AS matched_orders, round(sum(pow(confidence - "both" / '
            "nullif(matched, 0), 2)) / sum(matched), 9) AS mse, round(sqrt(sum(pow(confidence - \"both\" / "
            "nullif(matched, 0), 2)) / sum(matched)), 9) AS rmse FROM shelf_counts",
            "shelf_counts",
        ),
        "cluster_rule_metrics": metrics_sql("name", "cluster, "),
        "ranking_metrics": ranking_sql(False),
        "ranking_metrics_worst_first": ranking_sql(True),
        "item_gram": build(
            "SELECT a.item AS item_i, b.item AS item_j, CAST(sum(a.value * b.value) AS DOUBLE) AS dot "
            "FROM aisle_counts a JOIN aisle_counts b USING (user_id) GROUP BY ALL",
            "aisle_counts",
        ),
        "cluster_item_gram": build(
            "SELECT a.cluster::BIGINT AS cluster, a.item AS item_i, b.item AS item_j, "
            "CAST(sum(a.value * b.value) AS DOUBLE) AS dot FROM name_ratings a JOIN name_ratings b "
            "USING (cluster, user_id) GROUP BY ALL",
            "name_ratings",
        ),
        "svd_rank10_properties": build(
            "SELECT least(10, count(DISTINCT item)) AS components, true AS unit_columns, round(CAST(sum(value * "
            f"value) FILTER (WHERE {train('user_id')}) AS DOUBLE), 3) AS energy FROM aisle_counts",
            "aisle_counts",
        ),
        "cluster_svd_properties": build(
            "SELECT cluster::BIGINT AS cluster, least(50, count(DISTINCT item), count(DISTINCT user_id) FILTER "
            f"(WHERE {train('user_id')})) AS components, true AS unit_columns, round(CAST(sum(value * value) "
            f"FILTER (WHERE {train('user_id')}) AS DOUBLE), 3) AS energy FROM product_ratings GROUP BY cluster",
            "product_ratings",
        ),
        "svd_product_list_properties": build(
            "SELECT cluster::BIGINT AS cluster, count(DISTINCT user_id) AS n_users, count(DISTINCT user_id) * "
            "least(9, count(DISTINCT item)) AS n_rows, true AS scores_fall FROM product_ratings GROUP BY cluster",
            "product_ratings",
        ),
        "elbow_wcss": build("SELECT CAST(k AS INTEGER) AS k, round(wcss, 4) AS wcss FROM costs", "costs"),
        "segment_users": build(
            "SELECT user_id, CAST(CASE WHEN c IN (FROM spenders) THEN 2 WHEN c IN (FROM lapsed) THEN 1 "
            "WHEN c IN (FROM frequent) THEN 0 ELSE 3 END AS INTEGER) AS cluster FROM raw_segments",
            "raw_segments spenders lapsed frequent",
        ),
        "segment_balance": build(
            "SELECT least(4, count(*)) AS segments, count(*) AS n_users, round(sum(recency_scaled * recency_scaled "
            "+ frequency_scaled * frequency_scaled + monetary_scaled * monetary_scaled), 4) AS scatter FROM scaled",
            "scaled",
        ),
        "svd_energy": build(
            "SELECT count(DISTINCT item) AS components, round(CAST(sum(value * value) FILTER (WHERE "
            f"{train('user_id')}) AS DOUBLE), 3) AS energy, 1.0::DOUBLE AS kept_share FROM aisle_counts",
            "aisle_counts",
        ),
        "explained_variance": build(
            "SELECT component, round(sqrt(power), 6) AS sigma, round(share, 6) AS share, round(upto, 6) AS cumulative_share, "
            "round(power / energy, 6) AS share_of_total, min(component) FILTER (WHERE upto >= 0.95) OVER () AS components_for_95 "
            "FROM (SELECT *, sum(share) OVER (ORDER BY component) AS upto FROM (SELECT CAST(component AS INTEGER) AS component, "
            "power, energy, power / sum(power) OVER () AS share FROM leading10))",
            "leading10",
        ),
        "svd_recommend_aisles_rank10": build(
            "SELECT user_id, item AS aisle_id, round(score, 6) AS score, rank FROM rank10_list WHERE rank <= 5", "rank10_list"
        ),
        # On ten aisles the model keeps every component, so a user's row projects onto itself.
        "svd_recommend_own_aisles": build(
            "SELECT user_id, item AS aisle_id, true AS cluster_specific, round(score, 6) AS score, rank FROM own_ranked WHERE rank <= 5 "
            "UNION ALL SELECT user_id, item, false, round(score, 6), rank FROM rank10_list "
            "WHERE rank <= 5 AND user_id NOT IN (SELECT user_id FROM own_ranked)",
            "own_ranked",
        ),
        "svd_metrics_rank10": svd_metrics_rank10_sql(),
        "user_factors": build("SELECT DISTINCT user_id, 1.0::DOUBLE AS norm FROM aisle_counts", "aisle_counts"),
        "svd_metrics": build(
            "SELECT count(*) FILTER (WHERE value > 0) AS true_positives, 0::BIGINT AS false_positives, "
            "0::BIGINT AS false_negatives, count(*) FILTER (WHERE value = 0) AS true_negatives, "
            "count(DISTINCT user_id) AS n_users, 0.0::DOUBLE AS mse, 0.0::DOUBLE AS rmse, 0.0::DOUBLE AS mae, "
            "1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1_score, "
            "round(count(*) FILTER (WHERE value > 0 AND rank <= 5) / 5 / count(DISTINCT user_id), 6) "
            "AS precision_at_k, round((SELECT avg(least(n, 5) / n) FROM (SELECT count(*) AS n FROM "
            f"aisle_counts WHERE NOT {train('user_id')} GROUP BY user_id)), 6) AS recall_at_k, "
            "1.0::DOUBLE AS ndcg_at_k, 1.0::DOUBLE AS map_at_k, 1.0::DOUBLE AS hit_rate_at_k FROM "
            "(SELECT user_id, score AS value, rank FROM svd_list) "
            f"WHERE NOT {train('user_id')}",
            "svd_list aisle_counts",
        ),
        "similar_users": build(
            "SELECT user_id, neighbour, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY user_id "
            "ORDER BY s DESC, neighbour) AS INTEGER) AS rank FROM (SELECT a.user_id, b.user_id AS neighbour, "
            "round(sum(a.value * b.value) / (any_value(na.norm) * any_value(nb.norm)), 9) AS s FROM "
            "aisle_counts a JOIN aisle_counts b USING (item) JOIN norms na ON na.user_id = a.user_id JOIN norms nb "
            f"ON nb.user_id = b.user_id WHERE {train('b.user_id')} "
            "GROUP BY 1, 2) QUALIFY rank <= 10",
            "norms",
        ),
        "similar_users_rank10": build(
            "SELECT user_id, neighbour, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY user_id ORDER BY "
            "s DESC, neighbour) AS INTEGER) AS rank FROM (SELECT a.user_id, b.user_id AS neighbour, round(coalesce(sum(a.r * "
            "b.value) / nullif(any_value(x.length) * any_value(y.length), 0), 0), 9) AS s FROM rank10 a JOIN aisle_counts b USING (item) "
            "JOIN rank10_lengths x ON x.user_id = a.user_id JOIN rank10_lengths y ON y.user_id = b.user_id "
            f"WHERE a.user_id % {ASKED} = 0 AND {train('b.user_id')} GROUP BY 1, 2) QUALIFY rank <= 10",
            "rank10_lengths",
        ),
        "user_rule_list": build(
            f"SELECT user_id, {_SIDES}, "
            + ", ".join(
                f"(SELECT string_agg(coalesce(aisle, 'Aisle ' || x), ',' ORDER BY x) FROM unnest({c}s) u(x) LEFT JOIN aisles ON aisle_id = x) AS {c}_names"
                for c in ("antecedent", "consequent")
            )
            + " FROM (SELECT DISTINCT user_id, antecedents, consequents FROM triggered)",
            "triggered aisles",
        ),
        "order_history_rules": build(
            "SELECT user_id, order_id, order_number, CAST(count(t.rule) AS INTEGER) AS n_rules, "
            "coalesce(string_agg(t.rule, ';' ORDER BY t.rule), '') AS rules FROM clean_orders LEFT JOIN (SELECT order_id, "
            "array_to_string(antecedents, ',') || '>' || array_to_string(consequents, ',') AS rule FROM triggered) t "
            "USING (order_id) GROUP BY 1, 2, 3",
            "clean_orders triggered",
        ),
        "cluster_product_rules": rules_sql("product", "cluster, "),
        "product_page_bought_together": build(
            "SELECT a.user_id, a.product_id AS asked_id, a.cluster, b.rank, b.item AS product_id, product_name, "
            f"{r6('confidence', 'lift', 'support', 'score')} FROM (SELECT DISTINCT user_id, product_id, cluster FROM user_lines "
            f"JOIN seg USING (user_id) WHERE user_id % {ASKED} = 0) a JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY cluster, "
            "product ORDER BY score DESC, item) AS INTEGER) AS rank FROM (SELECT *, combined_score AS score FROM (SELECT *, "
            "unnest(consequents) AS item FROM (SELECT *, unnest(antecedents) AS product FROM product_rules)) QUALIFY row_number() "
            "OVER (PARTITION BY cluster, product, item ORDER BY combined_score DESC, antecedents, consequents) = 1) QUALIFY rank <= 5) b "
            "ON b.cluster = a.cluster AND b.product = a.product_id LEFT JOIN star ON star.product_id = b.item",
            "user_lines seg product_rules star",
        ),
        "stored_svd_model": build(
            "SELECT user_id, item AS aisle_id, score, rank FROM svd_list WHERE rank <= 5", "svd_list"
        ),
        "svd_recommend_aisles": build(
            "SELECT user_id, item AS aisle_id, score, rank FROM svd_list WHERE rank <= 5", "svd_list"
        ),
        "cluster_svd_recommend_aisles": build(
            "SELECT user_id, cluster_specific, item AS aisle_id, score, rank FROM cluster_list",
            "cluster_list",
        ),
        "svd_aisle_page": build(
            "SELECT user_id, item AS aisle_id, rank, score, coalesce(top_products, '') AS top_products "
            "FROM cluster_list JOIN seg USING (user_id) LEFT JOIN top_text ON top_text.cluster = seg.cluster "
            "AND top_text.aisle_id = item",
            "cluster_list seg top_text",
        ),
        "user_card": build(
            f"SELECT user_id, cluster, {cases('cluster', CARD_DESCRIPTIONS)} AS description, recency, frequency, "
            "monetary, CAST(frequency AS INTEGER) AS total_orders, round(monetary / frequency, 6) AS "
            "avg_order_value, CAST(recency AS INTEGER) AS days_since_last FROM seg",
            "seg",
        ),
        "order_history": build(
            "SELECT o.user_id, o.order_id, o.order_number, o.order_dow, o.order_hour_of_day AS order_hour, "
            "coalesce(a.aisles, '') AS aisles FROM clean_orders o LEFT JOIN (SELECT order_id, "
            "string_agg(aisle, ',' ORDER BY aisle) AS aisles FROM (SELECT DISTINCT order_id, aisle FROM "
            "user_lines JOIN aisles USING (aisle_id)) GROUP BY 1) a USING (order_id)",
            "clean_orders user_lines",
        ),
        "triggered_rules": build(
            f"SELECT user_id, order_id, {_SIDES}, {r6('confidence', 'lift', 'support')} FROM triggered",
            "triggered",
        ),
        "rule_summary": build(
            "SELECT user_id, count(*) AS total_rules_triggered FROM (SELECT DISTINCT user_id, antecedents, "
            "consequents FROM triggered) GROUP BY 1",
            "triggered",
        ),
        "cluster_aisle_top_products": build("SELECT * FROM top3", "top3"),
        "cluster_top_sold": build(
            "SELECT cluster, product_id, product_name, cluster_count, CAST(row_number() OVER (PARTITION BY "
            "cluster ORDER BY cluster_count DESC, product_id) AS INTEGER) AS rank FROM cluster_counts "
            "QUALIFY rank <= 10",
            "cluster_counts",
        ),
        "mba_recommendations": build(
            "SELECT user_id, cluster, aisle_id, aisle AS aisle_name, previously_bought, rank, "
            f"weight_confidence, weight_lift, {r6('confidence', 'lift', 'support', 'score')} "
            "FROM mba JOIN aisles USING (aisle_id)",
            "mba aisles",
        ),
        "mba_aisle_page": build(
            "SELECT user_id, m.aisle_id, rank, round(score, 6) AS score, coalesce(top_products, '') AS "
            "top_products FROM mba m LEFT JOIN top_text t ON t.cluster = m.cluster AND t.aisle_id = m.aisle_id",
            "mba top_text",
        ),
        "combined_recommendations": build(
            "SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY combined_score DESC, aisle_id) AS "
            "INTEGER) AS rank FROM (SELECT user_id, aisle_id, coalesce(aisle, 'Aisle ' || aisle_id) AS aisle_name, "
            "concat_ws(',', CASE WHEN m.score IS NOT NULL THEN 'MBA' END, CASE WHEN "
            "s.score IS NOT NULL THEN 'SVD' END) AS sources, round(m.score, 6) AS mba_score, "
            "round(confidence, 6) AS mba_confidence, round(lift, 6) AS mba_lift, round(s.score, 6) AS "
            "svd_score, round((coalesce(m.score, 0) + coalesce(s.score, 0)) / ((m.score IS NOT NULL)::INT + "
            "(s.score IS NOT NULL)::INT), 6) AS combined_score FROM mba m FULL JOIN (SELECT user_id, item AS "
            "aisle_id, score FROM cluster_list) s USING (user_id, aisle_id) LEFT JOIN aisles USING (aisle_id))",
            "mba cluster_list aisles",
        ),
        "other_aisles": build(
            "SELECT user_id, aisle_id FROM seg CROSS JOIN aisles ANTI JOIN mba USING (user_id, aisle_id)",
            "seg aisles mba",
        ),
        "user_aisle_products": build(
            "SELECT user_id, aisle_id, product_id, product_name, score, bought > 0 AS previously_bought, "
            "CAST(row_number() OVER (PARTITION BY user_id, aisle_id ORDER BY score DESC, product_id) AS INTEGER) "
            "AS rank FROM (SELECT m.user_id, m.aisle_id, p.product_id, p.product_name, coalesce(n, 0) AS bought, "
            "CASE WHEN n > 0 THEN n * 2 ELSE 1 END AS score FROM mba m JOIN products p USING (aisle_id) LEFT JOIN "
            "(SELECT user_id, product_id, count(*) AS n FROM user_lines GROUP BY ALL) b ON b.user_id = m.user_id "
            "AND b.product_id = p.product_id) QUALIFY rank <= 3",
            "mba products user_lines",
        ),
        "bought_together": bought_together_sql("DESC"),
        "bought_together_keep_last": bought_together_sql("ASC"),
        "last_login": "SELECT user_id, max(ts) AS last_login FROM events WHERE event_type = 'signup' GROUP BY 1",
        "carts_opened": "SELECT user_id, ts AS created_at FROM events WHERE event_type = 'signup'",
        "search_tokens": build(
            f"SELECT doc_id AS product_id, array_to_string({words('text')}, ' ') AS tokens FROM pdocs", "pdocs"
        ),
        "tfidf_weights": build(
            "SELECT doc_id AS product_id, term, round(weight, 6) AS weight FROM p_weights", "p_weights"
        ),
        "search_nlp": build(
            "SELECT query_id, doc_id AS product_id, round(nlp_score, 6) AS nlp_score FROM p_nlp", "p_nlp"
        ),
        "search_products": build(
            "SELECT query_id, rank, product_id, product_name, aisle, department, previously_bought, "
            f"{r6('nlp_score', 'svd_score', 'combined_score')} FROM found",
            "found",
        ),
        "search_totals": build(
            "SELECT query_id, count(*) AS total_results, count(DISTINCT aisle) AS n_aisles FROM found GROUP BY 1",
            "found",
        ),
        "search_by_aisle": build(
            "SELECT query_id, aisle, count(*) AS n_products, string_agg(product_name, ',' ORDER BY rank) AS "
            "product_names, arg_min(department, rank) AS department FROM found GROUP BY 1, 2",
            "found",
        ),
        "document_terms": build("SELECT term, df, round(idf, 6) AS idf FROM d_terms", "d_terms"),
        "document_search": build(
            "SELECT query_id, doc_id, rank, round(nlp_score, 6) AS nlp_score, "
            "round(combined_score, 6) AS combined_score FROM d_best",
            "d_best",
        ),
    }


cte("norms", "aisle_counts", "SELECT user_id, sqrt(sum(value * value)) AS norm FROM aisle_counts GROUP BY 1")
