"""The same questions in SQL, for a second engine over the same tables."""

from __future__ import annotations

from ..operators import conference
from . import loading_queries, page_queries, report_queries
from .queries import ALIASES, PART_NAMES, SCHOOLS, SHEET_HEAD, SLOTS, TEAM_MAP, TEAMS

PE = """WITH raw AS (
  SELECT event_id AS id, user_id AS athlete_id, 'Athlete ' || user_id AS athlete_name, event_type AS event, CAST(round(value * 100) AS BIGINT) AS c,
         'Team ' || (user_id % 12) AS team, ts AS date, CAST(ts AS DATE) AS day, props AS splits,
         event_id % 97 = 0 OR event_id % 101 = 0 AS invalid, event_type NOT IN ('purchase', 'signup') AS is_time
  FROM events
), pe AS (
  SELECT *, CASE WHEN day(day) <= 20 THEN '2024' ELSE '2025' END AS year, CASE WHEN day(day) > 10 AND day(day) <= 20 THEN 'Outdoor' ELSE 'Indoor' END AS season,
         'meet-' || CAST(day AS VARCHAR) AS meet_name,
         CASE WHEN invalid THEN 0 WHEN is_time THEN c ELSE -c END AS directed,
         CASE WHEN id % 97 = 0 THEN 'DNF' WHEN id % 101 = 0 THEN 'NH'
              WHEN NOT is_time THEN (c // 1200) || '-' || lpad(CAST(c % 1200 // 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
              WHEN c >= 6000 THEN (c // 6000) || ':' || lpad(CAST(c % 6000 // 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
              ELSE (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END AS mark
  FROM raw
)"""
PO = """WITH po AS (
  SELECT o_orderkey AS id, c_custkey AS athlete_id, c_name AS athlete_name, o_orderpriority AS event, n_name AS team, o_orderdate AS date, CAST(o_orderdate AS DATE) AS day,
         CAST(year(o_orderdate) AS VARCHAR) AS year, CASE WHEN month(o_orderdate) >= 11 OR month(o_orderdate) <= 3 THEN 'Indoor' ELSE 'Outdoor' END AS season,
         'meet-' || strftime(o_orderdate, '%Y-%m') AS meet_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
BEST = "row_number() OVER (PARTITION BY {keys} ORDER BY invalid, directed, date, id)"
POOL = f"""{PE}, ranked AS (SELECT *, {BEST.format(keys='event, season, year, athlete_id')} AS n FROM pe),
pool AS (SELECT *, row_number() OVER (PARTITION BY event, season, year ORDER BY directed, mark, id) AS place FROM ranked WHERE n = 1 AND NOT invalid),
placed AS (SELECT *, min(place) OVER (PARTITION BY event, season, year, mark) AS rank, count(*) OVER (PARTITION BY event, season, year, mark) AS tied FROM pool),
scored AS (SELECT *, list_sum(list_transform([10, 8, 6, 4, 2, 1], lambda p, i: CASE WHEN i >= rank AND i < rank + tied THEN p ELSE 0 END)) / tied AS points FROM placed)"""


def _first(value: str, entries: list[tuple[str, str]], test: str) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(v=f'lower({value})', k=key.lower())} THEN '{full}'" for key, full in entries) + " END"


def _school(schools: tuple[tuple[str, str], ...]) -> str:
    bar = {k: f" AND NOT contains(lower(team), '{word}')" for k, word in conference.UNLESS.items()}
    first = [f"WHEN (contains(lower(team), '{k.lower()}') OR lower(team) = '{full.lower()}'){bar.get(k, '')} THEN '{full}'" for k, full in schools]
    return f"CASE {' '.join(first)} {' '.join(f'WHEN contains(team, {chr(39)}{conference.ALSO[k]}{chr(39)}) THEN {chr(39)}{full}{chr(39)}' for k, full in schools if k in conference.ALSO)} END"


def _facet(name: str) -> str:
    tests = {"year": "year = '2024'", "season": "season = 'Indoor'", "team": "team = 'Team 3'"}
    return f"SELECT DISTINCT '{name}' AS facet, {name} AS option FROM pe WHERE " + " AND ".join(t for c, t in tests.items() if c != name)


NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(PART_NAMES))
EVENT_OF = {"4x8": "4X800m Relay", "55H": "55 M. Hurdles", "55": "55 M. Dash", "1mi": "One Mile", "400": "400 M. Run", "LJ": "Long Jump"}
SHEET = (
    "WITH long AS (SELECT CASE WHEN n_regionkey <= 2 THEN 'girls' ELSE 'boys' END AS gender, n_name AS name, event, col, "
    "['x', 'y', '', '(x)', '?', ''][1 + CAST((n_nationkey + col * n_nationkey + col) % 6 AS INTEGER)] AS role FROM nation, (VALUES "
    + ", ".join(f"({i}, '{EVENT_OF[h]}')" for i, h in enumerate(SHEET_HEAD))
    + ") e(col, event)), entries AS (SELECT * FROM long WHERE role <> '')"
)
SLOT_ROWS = ", ".join(f"({i}, '{s}', '{'girls' if 'Girls' in s else 'boys'}', '{s.replace('Girls', '').replace('Boys', '').replace('Prelim', '').replace('Final', '').strip()}')" for i, s in enumerate(SLOTS))
MATCH = f"""{SHEET}, met AS (
  SELECT s.ord, s.slot, e.name, arg_min(e.role, e.col) AS role FROM (VALUES {SLOT_ROWS}) s(ord, slot, gender, base)
  JOIN entries e ON e.gender = s.gender AND (contains(s.base, e.event) OR contains(e.event, s.base)) GROUP BY 1, 2, 3
)"""
POPS = f"""{PE}, seen AS (
  SELECT *, min(struct_pack(a := invalid, b := directed, d := date, i := id, m := mark)) OVER (PARTITION BY athlete_id, event ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prev,
         min(struct_pack(a := invalid, b := directed, d := date, i := id, m := mark)) OVER (PARTITION BY athlete_id, event ORDER BY date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old,
         row_number() OVER (PARTITION BY athlete_id, event, day ORDER BY invalid, directed, date, id) AS n
  FROM pe
), pops AS (SELECT * FROM seen WHERE n = 1 AND prev IS NOT NULL AND (invalid < prev.a OR (invalid = prev.a AND directed < prev.b)))"""
SEASON = "o_orderdate::DATE BETWEEN DATE '{}' AND DATE '{}'"
KEYWORDS = "High|School|Academy|Acad|Institute|MCI|GSA|MDI|EMITL|PVC|Relay|Track|Field|Team|Club|Middle|University|College"


#: the pool with relays, its entries taken one by one: each championship keeps the names that it has used, with repeats
RELAYS = f"""{POOL.replace("WITH ", "WITH RECURSIVE ", 1)}, who AS (
  SELECT * EXCLUDE (athlete_name), event IN ('view', 'signup') AS is_relay, CASE WHEN event NOT IN ('view', 'signup') THEN athlete_name WHEN athlete_id % 8 = 0 THEN team || ' Relay'
    ELSE 'Athlete ' || athlete_id || ', Athlete ' || (athlete_id + 12) || ', Athlete ' || (athlete_id + 24) || ', Athlete ' || (athlete_id + CASE WHEN athlete_id % 5 = 0 THEN 1 ELSE 36 END) END AS athlete_name FROM placed
), turns AS (
  SELECT *, CASE WHEN NOT is_relay THEN [athlete_name] WHEN contains(athlete_name, 'Relay') THEN [] ELSE string_split(athlete_name, ', ') END AS names,
    row_number() OVER (PARTITION BY year, season ORDER BY coalesce([10, 8, 6, 4, 2, 1][rank], 0) DESC, rank, is_relay, event, id) AS turn FROM who
), taken AS (
  SELECT year, season, 0::BIGINT AS turn, []::VARCHAR[] AS used, false AS fits FROM (SELECT DISTINCT year, season FROM turns)
  UNION ALL
  SELECT year, season, turn, CASE WHEN fits THEN list_concat(used, names) ELSE used END, fits FROM (
    SELECT t.year, t.season, t.turn, used, names, coalesce(list_bool_and(list_transform(names, lambda n: len(list_filter(used, lambda u: u = n)) < 3)), true) AS fits
    FROM taken k JOIN turns t ON t.year = k.year AND t.season = k.season AND t.turn = k.turn + 1)
), again AS (SELECT t.* EXCLUDE (rank, tied, place), row_number() OVER (PARTITION BY event, t.season, t.year ORDER BY directed, mark, id) AS place FROM turns t JOIN taken k ON k.year = t.year AND k.season = t.season AND k.turn = t.turn WHERE k.fits),
final AS (SELECT *, min(place) OVER (PARTITION BY event, season, year, mark) AS rank, count(*) OVER (PARTITION BY event, season, year, mark) AS tied FROM again)"""


def oracle_sql() -> dict[str, str]:
    return {
        "milestones": f"""{PE} SELECT id, athlete_id, event, season, year, mark,
            row_number() OVER (PARTITION BY athlete_id, event, season ORDER BY date, id) = 1 AS is_first, {BEST.format(keys='athlete_id, event, season')} = 1 AS is_pr, {BEST.format(keys='athlete_id, event, season, year')} = 1 AS is_sb FROM pe""",
        "mark_parse": f"{PE} SELECT id, mark, CASE WHEN invalid THEN 0.0 ELSE round(c / 100.0, 2) END::DOUBLE AS value, is_time OR invalid AS is_time, NOT invalid AS valid FROM pe",
        "mark_format": f"""{PE} SELECT id, CASE WHEN is_time THEN mark ELSE (c // 1200) || ''' ' || (c % 1200 // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || '"' END AS shown FROM pe WHERE NOT invalid""",
        "mark_improvement": f"""{PE}, v AS (SELECT *, lag(c) OVER (PARTITION BY athlete_id, event ORDER BY date, id) AS old FROM pe WHERE NOT invalid), i AS (SELECT *, abs(c - old) AS g FROM v WHERE (is_time AND c < old) OR (NOT is_time AND c > old))
            SELECT id, CASE WHEN is_time THEN '-' ELSE '+' END || (g // 100) || '.' || lpad(CAST(g % 100 AS VARCHAR), 2, '0') || CASE WHEN is_time THEN 's' ELSE '"' END AS improvement FROM i""",
        "api_athletes": f"{PO} SELECT c_custkey AS athlete_id, c_name AS athlete_name FROM customer WHERE c_custkey IN (SELECT athlete_id FROM po WHERE team = 'NATION_7' AND year = '1998' AND season = 'Indoor')",
        "api_teams": f"{PO} SELECT DISTINCT team FROM po WHERE NOT (length(team) < 4 AND team <> upper(team)) AND team NOT IN ('NATION_7', 'NATION_9')",
        "api_athlete_performances": f"{PO} SELECT id, event, team, date FROM po WHERE athlete_id = 7",
        "api_performances": f"{PO} SELECT id, athlete_id, athlete_name, event, date FROM po WHERE team = 'NATION_3'",
        "season_like": f"{PE} SELECT id, year || ' ' || season AS season FROM pe WHERE year || ' ' || season ILIKE '2024%' AND year || ' ' || season ILIKE '%indoor'",
        "season_parts": f"{PE} SELECT id, year, season, meet_name || ' (' || year || ')' AS meet_with_year FROM pe",
        "facets": f"{PE} " + " UNION ALL ".join(map(_facet, ("year", "season", "event", "team"))),
        "history_sorted": f"""{PE}, f AS (SELECT *, {BEST.format(keys='athlete_id, event, season')} AS n FROM pe)
            SELECT id, athlete_id, mark, CAST(row_number() OVER (PARTITION BY athlete_id ORDER BY invalid, directed, id) AS INTEGER) AS place FROM f WHERE n = 1""",
        "date_in_season": f"SELECT o_orderkey, {SEASON.format('1997-11-01', '1998-03-31')} AS indoor, {SEASON.format('1998-03-01', '1998-06-30')} AS outdoor FROM orders",
        "team_prefix_map": f"SELECT n_nationkey, coalesce({_first('n_name', TEAM_MAP, chr(123) + 'v' + chr(125) + ' LIKE ' + chr(39) + chr(123) + 'k' + chr(125) + '%' + chr(39))}, n_name) AS team FROM nation",
        "conference_tag": f"{PO}, t AS (SELECT team, {_first('team', SCHOOLS, 'contains(' + chr(123) + 'v' + chr(125) + ', ' + chr(39) + chr(123) + 'k' + chr(125) + chr(39) + ')')} AS conference FROM po) SELECT team, conference, count(*) AS n FROM t WHERE conference IS NOT NULL GROUP BY 1, 2",
        "conference_schools": f"""WITH t AS (SELECT c_custkey, {list(TEAMS)}[1 + c_custkey % {len(TEAMS)}] AS team, CASE WHEN c_nationkey % 2 = 0 THEN '2026' ELSE '2025' END AS year, CASE WHEN c_custkey % 2 = 0 THEN 'Indoor' ELSE 'Outdoor' END AS season FROM customer)
            SELECT *, CASE WHEN year = '2026' AND season = 'Indoor' THEN {_school(conference.SCHOOLS_OF['2026', 'Indoor'])} ELSE {_school(conference.SCHOOLS)} END AS school FROM t""",
        "display_date": f"{PE} SELECT id, strftime(date, '%Y-%m-%d') AS shown FROM pe",
        "result_table": f"""{PE}, r AS (SELECT *, {BEST.format(keys='event, season, year, athlete_id')} AS n FROM pe)
            SELECT event, season, year, athlete_id, mark, CAST(row_number() OVER (PARTITION BY event, season, year ORDER BY invalid, directed, date, id) AS INTEGER) AS place FROM r WHERE n = 1""",
        "record_counts": f"{PE} SELECT athlete_id, count(*) AS n, count(*) FILTER (id % 2 = 0) AS with_splits FROM pe WHERE year = '2024' AND season = 'Indoor' GROUP BY 1",
        "event_normalise": f"SELECT p_partkey, coalesce((SELECT name FROM (VALUES {NAMES}) s(ord, name) WHERE contains(lower(p_name), lower(name)) ORDER BY length(name) DESC, ord LIMIT 1), p_name) AS event FROM part",
        "athlete_flags": f"""SELECT p_partkey, CASE WHEN p_name = '' THEN true WHEN regexp_matches(p_name, '[0-9]') AND regexp_matches(p_name, '[.:-]') AND NOT contains(p_name, 'U-32') THEN true WHEN contains(p_name, '   ') THEN true
            WHEN regexp_matches(p_name, '(?i){KEYWORDS}') THEN false WHEN regexp_matches(p_name, '(?i)\\b(EL|HS|MS|U VT)\\b') THEN false WHEN contains(p_name, ',') THEN true
            WHEN regexp_matches(p_name, '^[A-Z][a-z.'']+\\s+([A-Z][a-z.'']+\\s*){{1,2}}$') THEN true ELSE length(p_name) < 3 END AS likely, p_size % 3 = 0 AS relay, CASE WHEN p_size % 2 = 0 THEN 'girls' ELSE 'boys' END AS gender FROM part""",
        "dedup_first": """WITH f AS (SELECT l_partkey, l_quantity, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_quantity ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_orderkey % 4 <> 0)
            SELECT l_partkey, l_quantity, l_orderkey, l_linenumber FROM f WHERE n = 1 AND (l_partkey, l_quantity) NOT IN (SELECT (l_partkey, l_quantity) FROM lineitem WHERE l_orderkey % 4 = 0)""",
        "last_values": "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1",
        "athlete_ids": f"""{PO}, s AS (SELECT athlete_name, min(id) AS first_seen FROM po GROUP BY 1), k AS (SELECT c_name, c_custkey FROM customer WHERE c_custkey % 3 = 0)
            SELECT athlete_name, coalesce(c_custkey, (SELECT max(c_custkey) FROM k) + row_number() OVER (PARTITION BY c_custkey IS NULL ORDER BY first_seen)) AS athlete_id FROM s LEFT JOIN k ON c_name = athlete_name""",
        "synced_anti": "SELECT o_orderkey AS key, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
        "best_per_group": f"{PE}, r AS (SELECT *, {BEST.format(keys='event, season, year, athlete_id')} AS n FROM pe) SELECT event, season, year, athlete_id, id, mark FROM r WHERE n = 1",
        "comp_rank": "WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_quantity AS INTEGER) DESC) AS rank FROM lineitem) SELECT *, CAST(coalesce([10, 8, 6, 4, 2, 1][rank], 0) AS DOUBLE) AS potential FROM r",
        "tie_points": """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_quantity AS INTEGER) DESC) AS rank, count(*) OVER (PARTITION BY l_suppkey, CAST(l_quantity AS INTEGER)) AS tied FROM lineitem),
            p AS (SELECT *, list_sum(list_transform([10, 8, 6, 4, 2, 1], lambda p, i: CASE WHEN i >= rank AND i < rank + tied THEN p ELSE 0 END)) / tied AS points FROM r) SELECT l_suppkey, l_orderkey, l_linenumber, round(points, 6)::DOUBLE AS points FROM p WHERE points > 0""",
        "championship": f"{POOL} SELECT event, season, year, athlete_id, mark, rank, round(points, 6)::DOUBLE AS points FROM scored",
        "team_scores": f"""{POOL} SELECT season, year, team, round(sum(points), 6)::DOUBLE AS total, count(*) AS n,
            list(event ORDER BY points DESC, event DESC, athlete_id DESC) AS events FROM scored WHERE points > 0 GROUP BY 1, 2, 3""",
        "relay_scores": f"""{RELAYS}
            SELECT year, season, event, id, athlete_name, rank, round(list_sum(list_transform([10, 8, 6, 4, 2, 1], lambda p, i: CASE WHEN i >= rank AND i < rank + tied THEN p ELSE 0 END)) / tied, 6)::DOUBLE AS points FROM final""",
        "scored_events": f"{PE}, e AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'Indoor Pentathlon ' || event ELSE event END AS event FROM pe) SELECT id, event FROM e WHERE regexp_matches(lower(event), 'click|tap|purchase') AND NOT contains(lower(event), 'pentathlon')",
        "greedy_scores": f"""{POOL}, turns AS (SELECT *, row_number() OVER (PARTITION BY year, season, athlete_name ORDER BY coalesce([10, 8, 6, 4, 2, 1][rank], 0) DESC, rank, event, id) AS turn FROM placed),
            again AS (SELECT * EXCLUDE (rank, tied, place), row_number() OVER (PARTITION BY event, season, year ORDER BY directed, mark, id) AS place FROM turns WHERE turn <= 3),
            final AS (SELECT *, min(place) OVER (PARTITION BY event, season, year, mark) AS rank, count(*) OVER (PARTITION BY event, season, year, mark) AS tied FROM again)
            SELECT year, season, event, id, athlete_name, rank, round(list_sum(list_transform([10, 8, 6, 4, 2, 1], lambda p, i: CASE WHEN i >= rank AND i < rank + tied THEN p ELSE 0 END)) / tied, 6)::DOUBLE AS points FROM final""",
        "missing_events": f"{PE}, g AS (SELECT DISTINCT year, season FROM pe), f AS (SELECT DISTINCT year, season, event FROM pe WHERE event <> 'view' OR season = 'Indoor') "
        + " UNION ALL ".join(f"SELECT year, season, '{name}' AS missing FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.year = g.year AND f.season = g.season AND ({' OR '.join(f'contains(f.event, {chr(39)}{a}{chr(39)})' for a in names)}))" for name, names in ALIASES.items()),
        "pr_pops": f"{POPS} SELECT id, athlete_id, event, day, mark, prev.m AS prev_mark, old.m AS old_pr FROM pops",
        "pop_summary": f"{POPS} SELECT athlete_id, athlete_name, count(*) AS n, string_agg(CAST(day AS VARCHAR) || ' ' || event || ' ' || mark, '; ' ORDER BY day, event) AS pops FROM pops GROUP BY 1, 2",
        "team_meets": f"{PE} SELECT DISTINCT meet_name, day FROM pe WHERE team = 'Team 3'",
        "latest_meet": f"{PE} SELECT team, arg_max(meet_name, date) AS meet_name, max(day) AS day FROM pe GROUP BY 1",
        "profile_stats": f"{PE} SELECT athlete_id, event, arg_min(mark, struct_pack(a := directed, b := date, c := id)) AS best_mark, round(list_sort(list(c))[count(*) // 2 + 1] / 100.0, 2)::DOUBLE AS upper_median, round(stddev_pop(c / 100.0), 4)::DOUBLE AS sigma, count(*) AS n FROM pe WHERE NOT invalid GROUP BY 1, 2",
        "profile_series": f"{PE} SELECT athlete_id, event, year, string_agg(strftime(date, '%Y-%m-%d %H:%M') || '=' || c, ',' ORDER BY date, id) AS series FROM pe WHERE NOT invalid GROUP BY 1, 2, 3",
        "unpivot_sheet": f"{SHEET} SELECT gender, name, event, role FROM entries",
        "sheet_match": f"{MATCH} SELECT ord, slot, name, role FROM met",
        "text_lines": "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, length(unnest(string_split(text, chr(10)))) AS n FROM documents",
        "block_segment": """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, length(unnest(string_split(text, chr(10)))) AS n FROM documents),
            h AS (SELECT *, coalesce(lead(n) OVER (PARTITION BY doc_id ORDER BY pos) > n, false) AS header FROM l), b AS (SELECT *, CAST(sum(CASE WHEN header THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS block FROM h)
            SELECT doc_id, block, count(*) AS lines, CAST(sum(n) AS BIGINT) AS chars FROM b GROUP BY 1, 2""",
        "carry_forward": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations",
        "status_counts": f"{PE} SELECT mark, count(*) AS n FROM pe WHERE invalid GROUP BY 1",
        "date_quality": f"{PO} SELECT CASE WHEN day = DATE '1997-06-01' THEN 'placeholder' WHEN day BETWEEN DATE '1997-11-01' AND DATE '1998-03-31' THEN 'valid' ELSE 'wrong season' END AS class, count(*) AS n FROM po GROUP BY 1",
        "digit_audit": """WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT count(DISTINCT doc_id) AS files, count(DISTINCT doc_id) AS events, count(*) AS entries,
            count(*) FILTER (regexp_matches(line, '[0-9]')) AS athlete_warnings, count(*) FILTER (regexp_matches(source, '[0-9]')) AS school_warnings FROM l""",
        "html_links": """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<(?:a|frame|iframe)\\b[^>]*?(?:href|src)="([^"]+)"', 1)) AS href FROM pages""",
        "year_from_url": """SELECT page_id, coalesce(nullif(regexp_extract('x/' || page_id || '/20' || url, '/(20[0-9]{2})', 1), ''), 'unknown') AS a,
            coalesce(nullif(regexp_extract(url, '/(20[0-9]{2})', 1), ''), nullif(regexp_extract(html, '(20[0-9]{2})', 1), ''), 'unknown') AS b FROM pages""",
        "splits_json": """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '["' || json_extract_string(props, '$.k') || '"]' AS splits FROM events""",
        "export": f"{PE} SELECT id, athlete_name, CAST(CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_splits FROM pe",
        "roster": f"{PO} SELECT athlete_id, arg_min(athlete_name, id) AS athlete_name FROM po WHERE team = 'NATION_12' GROUP BY 1",
        "filter_options": f"{PO}, o AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS facet, {c} AS option FROM po" for c in ("year", "season", "event", "meet_name"))
        + ") SELECT facet, option, CAST(row_number() OVER (PARTITION BY facet ORDER BY CASE WHEN facet = 'year' THEN -CAST(option AS INTEGER) END, option) AS INTEGER) AS place FROM o",
        "meet_pops": f"""{POPS.rsplit(", pops AS", 1)[0]}, latest AS (SELECT team, arg_max(meet_name, date) AS meet_name, max(day) AS day FROM pe GROUP BY 1),
            here AS (SELECT seen.*, row_number() OVER (PARTITION BY athlete_id, event, team, meet_name, day ORDER BY invalid, directed, date, id) AS best FROM seen JOIN latest USING (team, meet_name, day))
            SELECT team, meet_name, athlete_id, event, mark, prev.m AS prev_mark, old.m AS old_pr FROM here WHERE best = 1 AND prev IS NOT NULL AND (invalid < prev.a OR (invalid = prev.a AND directed < prev.b))""",
        "meet_sheet": f"""{MATCH}, people AS (
              SELECT m.ord, string_agg(m.name || CASE WHEN NOT contains(lower(m.slot), 'relay') THEN '' WHEN m.role = 'x' THEN ' (A)' WHEN m.role = 'y' THEN ' (B)' ELSE ' (Alt)' END, '; '
                ORDER BY CASE WHEN NOT contains(lower(m.slot), 'relay') THEN 0 WHEN m.role = 'x' THEN 1 WHEN m.role = 'y' THEN 2 WHEN m.role IN ('(x)', '(y)') THEN 3 ELSE 9 END, n_nationkey) AS entries
              FROM met m JOIN nation ON n_name = m.name GROUP BY 1)
            SELECT s.ord, s.slot, CAST(s.ord + 1 AS INTEGER) AS number, CASE WHEN s.ord < {-(-len(SLOTS) // 2)} THEN 1 ELSE 2 END AS "column", coalesce(entries, '') AS entries, contains(s.slot, '55') AND contains(s.slot, 'Final') AS tentative
            FROM (VALUES {SLOT_ROWS}) s(ord, slot, gender, base) LEFT JOIN people p ON p.ord = s.ord""",
        "union_pages": f"{PE} SELECT id, season FROM pe",
        "union_distinct": f"{PE} SELECT DISTINCT team, event FROM pe",
    } | page_queries.SQL | report_queries.sql(PE) | loading_queries.sql(PE)
