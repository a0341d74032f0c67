"""Pieces of the checking SQL (DuckDB dialect), written apart from the Spark expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from voicelane import fixed_values as V
from voicelane.plans.reviews import VIEW

REVIEWS = "reviews_v AS (" + VIEW.format(documents="documents", labels="labels") + ")"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text_list(values: Sequence[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in V.WHITESPACE) + ")"


def strip(expression: str) -> str:
    return f"trim({expression}, {WS})"


def any_word(lowered: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {text(w)})" for w in words) + ")"


def keyword_labels(lowered: str, lexicon: Mapping[str, Sequence[str]] = V.LEXICON) -> str:
    cases = ", ".join(
        f"CASE WHEN {any_word(lowered, words)} THEN {text(name)} END"
        for name, words in lexicon.items()
    )
    return (
        f"coalesce(nullif(list_filter([{cases}], lambda c: c IS NOT NULL), CAST([] AS VARCHAR[])), "
        f"[{text(V.DEFAULT_CATEGORY)}])"
    )


def word_sentiment(lowered: str) -> str:
    good, bad = any_word(lowered, V.POSITIVE_WORDS), any_word(lowered, V.NEGATIVE_WORDS)
    return (
        f"CASE WHEN {good} AND NOT {bad} THEN 'positive' "
        f"WHEN {bad} AND NOT {good} THEN 'negative' ELSE 'mixed' END"
    )


PRECOMPUTED = (
    f"coalesce(sentiment IN {in_list(V.SENTIMENTS)} AND categories IS NOT NULL, false)"
)

SCORED = f"""marked_v AS (
  SELECT *, lower(review) AS low, {PRECOMPUTED} AS precomputed FROM reviews_v),
scored_v AS (
  SELECT * EXCLUDE (low, sentiment, categories),
    CASE WHEN precomputed THEN sentiment ELSE {word_sentiment('low')} END AS sentiment,
    CASE WHEN precomputed THEN categories ELSE {keyword_labels('low')} END AS categories
  FROM marked_v)"""

MENTIONS = """mentions_v AS (
  SELECT *, list_position(categories, category) AS place FROM (
    SELECT *, unnest(categories) AS category FROM scored_v))"""


def with_reviews(body: str) -> str:
    return f"WITH {REVIEWS} {body}"


def with_scored(body: str, *more: str) -> str:
    return f"WITH {', '.join([REVIEWS, SCORED, *more])} {body}"


def with_mentions(body: str, *more: str) -> str:
    return with_scored(body, MENTIONS, *more)


def percent(part: str, whole: str) -> str:
    return (
        f"coalesce(CAST(round_even(100 * ({part}) / nullif(CAST({whole} AS DOUBLE), 0), 0) "
        "AS BIGINT), 0)"
    )


def two_decimals(expression: str) -> str:
    return f"CAST(printf('%.2f', {expression}) AS DOUBLE)"


def nps_score(promoters: str, detractors: str, scores: str) -> str:
    return (
        f"CAST(round_even((({promoters}) - ({detractors})) / nullif(CAST({scores} AS DOUBLE), 0) "
        "* 100, 0) AS BIGINT)"
    )


def md5_mod(seed: str, n: int) -> str:
    digits = (
        f"list_transform(range(1, 33), lambda k: "
        f"CAST(instr('0123456789abcdef', md5({seed})[k]) - 1 AS BIGINT))"
    )
    return f"list_reduce({digits}, lambda a, x: (a * 16 + x) % {n}, CAST(0 AS BIGINT))"


def md5_bucket(key: str, n: int) -> str:
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) % {n}"


def natural(category: str) -> str:
    cases = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in V.NATURAL_PHRASES.items())
    return f"CASE {category} {cases} ELSE lower({category}) END"


def phrases(categories: str) -> str:
    return f"list_transform({categories}, lambda c: {natural('c')})"


def join_and(items: str) -> str:
    return (
        f"CASE WHEN len({items}) = 1 THEN {items}[1] ELSE "
        f"array_to_string({items}[1:len({items}) - 1], ', ') || ' and ' || {items}[len({items})] END"
    )


def tuple_text(items: str) -> str:
    """For items without quotes or backslashes."""
    body = f"array_to_string(list_transform({items}, lambda p: '''' || p || ''''), ', ')"
    return f"'(' || {body} || CASE WHEN len({items}) = 1 THEN ',' ELSE '' END || ')'"


def choose(index: str, templates: Sequence[str], **values: str) -> str:
    cases = []
    for i, template in enumerate(templates):
        body = text(template)
        for name, value in values.items():
            body = f"replace({body}, '{{{name}}}', {value})"
        cases.append(f"WHEN {i} THEN {body}")
    return f"CASE {index} {' '.join(cases)} END"


def context(provider: str, location: str, renter: str) -> str:
    who = f"coalesce(nullif({renter}, ''), nullif({provider}, ''))"
    return (
        f"coalesce(nullif(concat_ws(' at ', {who}, nullif({location}, '')), ''), "
        f"{text(V.NO_CONTEXT)})"
    )


SUMMARY_COLUMNS = [
    "provider", "location", "renter", "total_reviews", "positive", "negative", "mixed",
    "positive_pct", "negative_pct", "mixed_pct", "top_categories", "upselling_count",
    "hidden_fees_count", "damage_claims_count", "car_condition_rating", "processing_speed_rating",
    "service_level_rating", "promoters", "passives", "detractors", "nps_score",
    "aggregate_summary",
]


def summary(sets: Sequence[Sequence[str]] | None = None, request: str | None = None) -> str:
    """The full summary of each (provider, location, renter), of each subset in ``sets``, or of each
    scope and ``request`` (an expression), named ``scope_level``."""
    keys = ["provider", "location", "renter"]
    if sets is None and request is None:
        source, extra = "scored_v", []
    else:
        source, extra = "levels_v", ["scope_level"]
    key = ", ".join([*extra, *keys])

    def on(a: str, b: str) -> str:
        return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in [*extra, *keys])

    ctes = []
    if request is not None:
        ctes.append(f"levels_v AS (SELECT {request} AS scope_level, * FROM scored_v)")
    if sets is not None:
        branches = []
        for chosen in sets:
            level = ",".join(k for k in keys if k in chosen)
            replaced = ", ".join(f"NULL AS {k}" for k in keys if k not in chosen)
            replace = f"REPLACE ({replaced})" if replaced else ""
            branches.append(f"SELECT {text(level)} AS scope_level, * {replace} FROM scored_v")
        ctes.append(f"levels_v AS ({' UNION ALL '.join(branches)})")
    flag = "count(*) FILTER (WHERE list_contains(categories, {}))"
    ctes += [
        f"""base AS (SELECT {key}, count(*) AS total,
          count(*) FILTER (WHERE sentiment = 'positive') AS pos, count(*) FILTER (WHERE sentiment = 'negative') AS neg,
          count(*) FILTER (WHERE sentiment = 'mixed') AS mix,
          {flag.format(text('Insurance & Upselling'))} AS ups,
          {flag.format(text('Hidden Fees & Billing'))} AS fees,
          {flag.format(text('Vehicle Condition'))} AS dmg,
          avg(car_condition_rating) AS r1, avg(processing_speed_rating) AS r2,
          avg(service_level_rating) AS r3,
          count(recommendation_rating) AS scores, count(*) FILTER (WHERE recommendation_rating >= 9) AS pro,
          count(*) FILTER (WHERE recommendation_rating <= 6) AS det FROM {source} GROUP BY {key})""",
        f"""said AS (SELECT *, list_position(categories, category) AS place FROM (
          SELECT *, unnest(categories) AS category FROM {source}))""",
        f"""cats AS (SELECT {key}, category, count(*) AS n,
          count(*) FILTER (WHERE sentiment = 'positive') - count(*) FILTER (WHERE sentiment = 'negative') AS net,
          min((CASE WHEN precomputed THEN 0 ELSE 1 END, ordinal, place)) AS met
          FROM said GROUP BY {key}, category)""",
        f"""ranked AS (SELECT *,
          row_number() OVER (PARTITION BY {key} ORDER BY n DESC, met, category) AS top_no,
          row_number() OVER (PARTITION BY {key}, net > 0, net < 0
            ORDER BY abs(net) DESC, category) AS net_no FROM cats)""",
        f"""lists AS (SELECT {key},
          coalesce(list(category ORDER BY top_no) FILTER (WHERE top_no <= 3), []) AS tops,
          coalesce(list(category ORDER BY net_no) FILTER (WHERE net > 0 AND net_no <= 3), [])
            AS praised,
          coalesce(list(category ORDER BY net_no) FILTER (WHERE net < 0 AND net_no <= 2), [])
            AS complained FROM ranked GROUP BY {key})""",
        f"""joined AS (SELECT b.*, coalesce(l.tops, []) AS tops, coalesce(l.praised, []) AS praised,
          coalesce(l.complained, []) AS complained, {context('b.provider', 'b.location', 'b.renter')} AS ctx,
          {percent('pos', 'total')} AS pos_pct, {percent('neg', 'total')} AS neg_pct,
          {percent('mix', 'total')} AS mix_pct
          FROM base b LEFT JOIN lists l ON {on('b', 'l')})""",
        f"""worded AS (SELECT *, {phrases('praised')} AS good,
          list_concat(CASE WHEN neg_pct > 15 THEN {phrases('complained')} ELSE [] END,
            CASE WHEN ups > 0 THEN ['insurance upselling'] ELSE [] END,
            CASE WHEN fees > 0 THEN ['unexpected charges'] ELSE [] END,
            CASE WHEN dmg > 0 THEN ['disputed damage claims'] ELSE [] END) AS bad FROM joined)""",
        """capped AS (SELECT *, (list_filter(bad, lambda x, i: list_position(bad, x) = i))[1:2]
          AS issues FROM worded)""",
        f"""told AS (SELECT *,
          CASE WHEN len(good) > 0 AND pos_pct > 15 THEN
            {choose(md5_mod(f"ctx || '|' || pos_pct || '|' || {tuple_text('good')}", 3),
                    V.POSITIVE_TEMPLATES, phrases=join_and('good'), context='ctx',
                    pct='CAST(pos_pct AS VARCHAR)')}
          ELSE {choose(md5_mod("ctx || '|' || total", 2), V.FALLBACK_TEMPLATES, context='ctx')} END
          || CASE WHEN len(issues) > 0 THEN ' ' ||
            {choose(md5_mod(f"ctx || '|' || {tuple_text('issues')}", 3), V.NEGATIVE_TEMPLATES,
                    phrases=join_and('issues'))} ELSE '' END AS summary_text FROM capped)""",
    ]
    body = f"""SELECT {key}, total AS total_reviews, pos AS positive, neg AS negative, mix AS mixed,
      pos_pct AS positive_pct, neg_pct AS negative_pct, mix_pct AS mixed_pct,
      array_to_string(tops, ' | ') AS top_categories,
      ups AS upselling_count, fees AS hidden_fees_count, dmg AS damage_claims_count,
      {two_decimals('r1')} AS car_condition_rating, {two_decimals('r2')} AS processing_speed_rating,
      {two_decimals('r3')} AS service_level_rating,
      pro AS promoters, scores - pro - det AS passives, det AS detractors,
      {nps_score('pro', 'det', 'scores')} AS nps_score, summary_text AS aggregate_summary FROM told"""
    return with_scored(body, *ctes)
