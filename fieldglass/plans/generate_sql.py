"""SQL of generated records, data set layout and noise selection: what those queries must return, in DuckDB's dialect.

`k` is the text that a row's choices are hashed from; the names in the hashes are those of operators/generate.py.
"""

from __future__ import annotations

from ..operators import domains, generate
from .noise_sql import below, listed, pick, q, u


def _pool(values: list[str], *parts: str) -> str:
    return pick(listed(values), *parts)


def _values(domain: str) -> dict[str, str]:
    """SQL of each field's value by path."""
    key = lambda name: ("k", q(domain), q(name))
    day = lambda first, days, name: f"strftime(DATE {q(first)} + {below(str(days), *key(name))}, '%Y-%m-%d')"
    maybe = lambda value, missing, name: f"CASE WHEN {u(*key(name))} >= {missing} THEN {value} END"
    choice = lambda values, name: _pool(values, *key(name))
    between = lambda low, high, name: f"({low} + {below(str(high - low + 1), *key(name))})"
    text = lambda x: f"CAST({x} AS VARCHAR)"
    code = lambda prefix, low, high, name: f"{q(prefix)} || {text(between(low, high, name))}"
    money = lambda low, high, name: f"round({low} + {u(*key(name))} * {high - low}, 2)"
    hour = lambda low, high, name: f"lpad({text(between(low, high, name + 'h'))}, 2, '0') || ':' || lpad({text(f'{below(str(4), *key(name + chr(109)))} * 15')}, 2, '0')"
    name = lambda n: f"{choice(generate.FIRST, n + '1')} || ' ' || {choice(generate.LAST, n + '2')}"
    phone = maybe(f"{choice(['98', '97', '96', '95', '94'], 'p1')} || lpad({text(below('100000000', *key('p2')))}, 8, '0')", 0.35, "p0")
    address = maybe(f"{text(between(1, 400, 'a1'))} || ' ' || {choice(generate.STREETS, 'a2')} || ', ' || {choice(generate.CITIES, 'a3')}", 0.45, "a0")
    if domain == "receipts":
        subtotal = money(80, 4500, "subtotal")
        tax = f"round({subtotal} * ([0.05, 0.12, 0.18]::DOUBLE[])[{below('3', *key('rate'))} + 1], 2)"
        return {
            "vendor_name": choice(generate.SHOPS, "vendor"), "date": day("2022-01-01", 1096, "date"), "time": maybe(hour(8, 21, "time"), 0.2, "time0"), "receipt_number": maybe(code("RCT-", 10_000, 99_999, "no"), 0.15, "no0"),
            "subtotal": maybe(text(subtotal), 0.2, "sub0"), "tax_amount": maybe(text(tax), 0.2, "tax0"), "total_amount": text(f"round({subtotal} + {tax}, 2)"), "currency": q("INR"),
            "payment_method": maybe(choice(generate.PAYMENTS, "pay"), 0.1, "pay0"), "line_items": maybe(f"{choice(generate.ITEMS, 'i1')} || ', ' || {choice(generate.ITEMS, 'i2')}", 0.25, "i0"),
        }
    if domain == "insurance":
        start = f"(DATE '2018-01-01' + {below('2373', *key('start'))})"
        end = f"strftime({start} + to_years(({below('6', *key('years'))} + 1) * 5), '%Y-%m-%d')"
        return {
            "policyholder.name": name("name"), "policyholder.dob": day("1955-01-01", 18_628, "dob"), "policyholder.gender": choice(["Male", "Female"], "sex"), "policyholder.contact_number": phone, "policyholder.address": address,
            "policy.policy_number": code("AG-", 100_000, 999_999, "policy"), "policy.policy_type": choice(generate.POLICIES, "type"), "policy.start_date": f"strftime({start}, '%Y-%m-%d')", "policy.end_date": maybe(end, 0.4, "end"),
            "premium.amount": text(money(300, 30_000, "amount")), "premium.currency": q("INR"), "premium.payment_frequency": choice(generate.FREQUENCIES, "freq"),
            "agent.name": maybe(name("agent"), 0.1, "agent0"), "agent.agent_id": maybe(code("AGT-", 100, 999, "aid"), 0.1, "aid0"),
        }
    insured = lambda value: f"CASE WHEN {u(*key('insured'))} > 0.3 THEN {value} END"
    warm = f"round(97.0 + {u(*key('temp'))} * 6.5, 1)"
    pressure = f"{text('100 + ' + below('14', *key('bp1')) + ' * 5')} || '/' || {text('60 + ' + below('9', *key('bp2')) + ' * 5')}"
    why = f"CASE WHEN {u(*key('why'))} < 0.2 THEN {choice(generate.VISITS, 'why1')} ELSE {choice(generate.SYMPTOMS, 'why2')} || ' ' || {choice(generate.SINCE, 'why3')} END"
    return {
        "patient.name": name("name"), "patient.dob": day("1940-01-01", 30_681, "dob"), "patient.gender": choice(["Male", "Female"], "sex"), "patient.blood_group": maybe(choice(generate.BLOOD, "blood"), 0.15, "blood0"),
        "patient.contact_number": phone, "patient.address": address, "visit.date": day("2021-01-01", 1461, "date"), "visit.time": maybe(hour(7, 20, "time"), 0.15, "time0"),
        "visit.department": maybe(choice(generate.DEPARTMENTS, "dept"), 0.05, "dept0"), "visit.reason_for_visit": why, "vitals.blood_pressure": maybe(pressure, 0.1, "bp0"), "vitals.pulse": maybe(text(between(55, 114, "pulse")), 0.1, "pulse0"),
        "vitals.temperature": maybe(f"CASE WHEN {u(*key('unit'))} < 0.5 THEN {text(warm)} || 'F' ELSE {text(f'round(({warm} - 32) * 5 / 9, 1)')} || 'C' END", 0.15, "temp0"),
        "vitals.weight": maybe(f"{text(between(38, 130, 'weight'))} || ' kg'", 0.4, "weight0"), "vitals.height": maybe(f"{text(between(140, 195, 'height'))} || ' cm'", 0.4, "height0"),
        "insurance.provider": insured(choice(generate.PAYERS, "payer")), "insurance.policy_number": insured(code("INS-", 100_000, 999_999, "ins")),
        "attending_physician.name": maybe(f"'Dr ' || {name('doctor')}", 0.05, "doctor0"), "attending_physician.id": maybe(code("REG-", 1000, 9999, "reg"), 0.1, "reg0"),
    }


def records(domain: str, n: int, seed: int = 42) -> str:
    """(id, path, value) of the first n records of a domain."""
    items = ", ".join(f"{{'path': {q(path)}, 'value': {value}}}" for path, value in _values(domain).items())
    return f"""WITH g AS (SELECT printf('{domains.PREFIXES[domain]}_%06d', i) AS id, '{seed}-' || CAST(i AS VARCHAR) AS k FROM range({n}) AS x(i)),
v AS (SELECT id, unnest([{items}]) AS f FROM g) SELECT id, f.path AS path, f.value AS value FROM v WHERE f.value IS NOT NULL"""


def weighted(weights: dict[str, float], *parts: str) -> str:
    """SQL of functions.text.by_weight."""
    at, total, cases = 0.0, sum(weights.values()), []
    for name, w in weights.items():
        at += w
        cases.append(f"WHEN {u(*parts)} * {total} < {min(at, total)!r} THEN {q(name)}")
    return f"CASE {' '.join(cases)} ELSE {q(list(weights)[-1])} END"


def layout(per_cell: int, seed: int = 42) -> str:
    """Id, domain, difficulty, task and split of a data set with per_cell samples of each domain and difficulty."""
    ids = " UNION ALL ".join(f"SELECT printf('{domains.PREFIXES[d]}_%06d', i) AS id, {q(d)} AS domain, ({listed(domains.DIFFICULTIES)})[i // {per_cell} + 1] AS difficulty FROM range({per_cell * 4}) AS x(i)" for d in domains.DOMAINS)
    tasks = " ".join(f"WHEN difficulty = {q(d)} THEN {weighted(w, q(str(seed)), 'id', q('task'))}" for d, w in domains.TASKS.items())
    return f"""WITH g AS ({ids}), n AS (SELECT *, count(*) OVER (PARTITION BY domain, difficulty) AS n, row_number() OVER (PARTITION BY domain, difficulty ORDER BY md5('{seed}-' || id), '{seed}-' || id) AS r FROM g)
SELECT id, domain, difficulty, CASE {tasks} END AS task, CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.8) THEN 'dev' ELSE 'test' END AS split, 'synthetic' AS track, 'synthetic' AS source_type FROM n"""


def selection(table: str, domain: str) -> str:
    """CTEs over a table (id, difficulty): picked has the tags that noise.select draws, in order, joined by commas."""
    weights = [{t: w for t, w in tier.items() if domain in domains.NOISE_DOMAINS.get(t, [domain])} for tier in domains.NOISE_WEIGHTS]
    count = lambda tier: "CASE difficulty " + " ".join(f"WHEN {q(d)} THEN {c[tier][0]} + {below(str(c[tier][1] - c[tier][0] + 1), 'id', q('count'), q(str(tier)))}" for d, c in domains.NOISE_COUNTS.items()) + " END"
    first = ", ".join(f"{{'o': -ln({u('id', q('tag'), q(t))} + 1e-12) / {w}, 't': {q(t)}}}" for t, w in weights[0].items())
    later = []
    for tier in (1, 2):
        most = max(c[tier][1] for c in domains.NOISE_COUNTS.values())
        drawn = ", ".join(weighted(weights[tier], "id", q("tier"), q(str(tier)), q(str(i))) for i in range(most))
        later.append(f"([{drawn}])[1:{count(tier)}]")
    return f"""chosen AS (SELECT id, list_transform(list_sort([{first}]), lambda s: s.t)[1:{count(0)}] AS a, {later[0]} AS b, {later[1]} AS c FROM {table}),
picked AS (SELECT id, array_to_string(list_concat(list_concat(a, b), c), ',') AS tags FROM chosen)"""


def texts(domain: str, n: int, seed: int = 42) -> str:
    """(id, raw_text) of the first n records of a domain as forms: lines by the order of a hash within their section, sections in
    the order of the schema, now and then a blank line behind a nested one."""
    formats = ["%d/%m/%Y", "%d-%m-%Y", "%d %b %Y", "%Y-%m-%d"]
    values, rows, sections = _values(domain), [], list(dict.fromkeys(f.section for f in domains.fields(domain)))
    for f in domains.fields(domain):
        key = lambda name, p=f.path: ("key", q(p), q(name))
        shown = "v"
        if f.kind == "number":
            x = "CAST(v AS DOUBLE)"
            shown = f"CASE WHEN {x} = floor({x}) THEN format('{{:,.0f}}', {x}) ELSE format('{{:,.2f}}', {x}) END"
        elif f.kind == "date":
            shown = f"([{', '.join(f'strftime(CAST(v AS DATE), {q(x)})' for x in formats)}])[{below('4', *key('date'))} + 1]"
        text = f"{_pool(list(f.labels), *key('label'))} || {weighted({': ': 70, ':': 20, ' : ': 10}, *key('sep'))} || {shown}"
        rows.append(f"SELECT id, key, {sections.index(f.section)} AS place, {q(f.section)} AS section, {u(*key('order'))} AS o, {text} AS t FROM (SELECT id, key, {values[f.path]} AS v FROM g) WHERE v IS NOT NULL")
    blank = f"CASE WHEN section <> '' AND {u('any_value(key)', 'section', q('blank'))} < 0.3 THEN chr(10) ELSE '' END"
    return f"""SELECT id, trim(string_agg(part, chr(10) ORDER BY place), ' ' || chr(10)) AS raw_text FROM (
  SELECT id, place, string_agg(t, chr(10) ORDER BY o, t) || {blank} AS part FROM ({' UNION ALL '.join(rows)}) GROUP BY id, place, section)
GROUP BY id""".replace("FROM g)", f"FROM (SELECT printf('{domains.PREFIXES[domain]}_%06d', i) AS id, '{seed}-' || CAST(i AS VARCHAR) AS k, '{seed}-' || printf('{domains.PREFIXES[domain]}_%06d', i) AS key FROM range({n}) AS x(i)))")
