"""The registered queries in DuckDB SQL.

The statements share the rule data and the derived inputs with the Spark jobs, and
nothing else: matching, gating, parsing and folding are written for DuckDB's own
functions and its RE2 patterns.
"""

from __future__ import annotations

import re

from tracewarden.dialect import Pattern, quote
from tracewarden.operators.redact import Policy, compile_policy, preset
from tracewarden.plans import derived as d
from tracewarden.plans import queries as q
from tracewarden.rules.base import Rule
from tracewarden.rules.credentials import CREDENTIALS
from tracewarden.rules.injection import INJECTION, ROLE_CONFUSION, SUSPICIOUS_UNICODE
from tracewarden.rules.models import CACHE_SHARES, MODELS
from tracewarden.rules.output import BANNED, BLOCKED_DOMAINS, DANGEROUS_CODE
from tracewarden.rules.redaction import PRESETS
from tracewarden.rules.routing import API_SEGMENTS, SENSITIVE_HEADERS, UPSTREAMS

_SPACES = r"\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: Pattern) -> str:
    """The pattern for RE2, as a SQL literal."""
    out = []
    for m in re.finditer(r"\[\^?(?:\\.|[^\]\\])*\]|\\u[0-9A-Fa-f]{4}|\\.|.", pattern.source, re.S):
        t = m.group()
        if t == r"[\s\S]":
            t = r"(?s:.)"
        elif t.startswith("["):
            t = re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", t).replace(r"\s", _SPACES)
            t = t[0] + t[1:].replace("[", r"\[") if "[" in t[1:] else t
        elif t == r"\s":
            t = f"[{_SPACES}]"
        elif t.startswith(r"\u"):
            t = r"\x{" + t[2:] + "}"
        elif t == ".":
            t = r"[^\n\r\x{2028}\x{2029}]"
        elif t == r"\/":
            t = "/"
        out.append(t)
    flags = pattern.flags
    return lit((f"(?{flags})" if flags else "") + "".join(out))


def pick(n: str, options) -> str:
    items = ", ".join(lit(o) for o in options)
    return f"([{items}])[cast(({n}) % {len(options)} as int) + 1]"


PLANTED = f"(select doc_id, lang, source, text || {pick('doc_id', d.PLANTED)} as text from documents)"
MESSAGES = (
    "(select conv_id, turn, case when role = 'assistant' and conv_id % 3 <> 1 then 'tool' else role end as role, "
    f"text || {pick('conv_id + turn * 11', d.PLANTED)} as text from conversations)"
)
CAPTURES = "(" + d.captures_sql("conversations", d.DUCKDB_HISTORY) + ")"
PLANTED_CAPTURES = "(" + d.captures_sql(MESSAGES, d.DUCKDB_HISTORY) + ")"


def header_map(pairs) -> str:
    return "map {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in pairs) + "}"


LOG = (
    "(select event_id, ts, "
    f"{pick('event_id', d.METHODS)} as method, {pick('event_id', d.PATHS)} as path, "
    "case when event_id % 3 = 0 then '?k=1' end as query, "
    f"([{', '.join(header_map(h) for h in d.HEADERS)}])[cast(event_id % {len(d.HEADERS)} as int) + 1] as headers, "
    f"{pick('event_id', d.PEERS)} as peer, "
    "case when event_id % 5 = 4 then 'not json' else props end as body, value from events)"
)
SAFE_JSON = "try_cast({} as json)"
CUT = "case when length(m) > 120 then substr(m, 1, 117) || '...' else m end"


def digest(column: str) -> str:
    return f"length({column}) as chars, md5({column}) as md5"


# --- matches ------------------------------------------------------------------


def first_match(relation: str, keys: str, pattern: Pattern, ord_: int, label: str, severity: str, where: str = "true") -> str:
    p = re2(pattern)
    flags = f"(?{pattern.flags}s)" if pattern.flags else "(?s)"
    inner = p[1:-1]
    if inner.startswith("(?"):
        inner = inner[inner.index(")") + 1 :]
    before = f"'{flags}\\A(.*?)(?:{inner})'"
    return (
        f"select {keys}, {ord_} as rule_ord, {lit(label)} as pattern, {lit(severity)} as severity, "
        f"regexp_extract(text, {p}) as m, length(regexp_extract(text, {before}, 1)) as off "
        f"from {relation} where {where} and regexp_matches(text, {p})"
    )


def every_match(relation: str, keys: str, pattern: Pattern, fields: str, text: str = "text", group: int = 0) -> str:
    """keys, fields, i, m, c, off of every match, by marking the matches in place."""
    p = re2(pattern)
    marked = f"string_split(regexp_replace({text}, {p}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
    groups = f"regexp_extract_all({text}, {p}, {group})"
    return (
        f"select {keys}, {fields}, i - 2 as i, split_part(parts[i], chr(2), 1) as m, cs[i - 1] as c, "
        "length(replace(array_to_string(parts[1:i-1], ''), chr(2), '')) as off from "
        f"(select *, unnest(range(2, len(parts) + 1)) as i from (select {keys}, {marked} as parts, {groups} as cs "
        f"from {relation} where regexp_matches({text}, {p})))"
    )


def entropy(value: str) -> str:
    share = f"((length({value}) - length(replace({value}, ch, ''))) / length({value}))"
    return f"list_sum(list_transform(list_distinct(string_split({value}, '')), lambda ch: -({share} * log2({share}))))"


def same_letter(value: str) -> str:
    return f"(length({value}) = 39 and length(replace(substr({value}, 5), substr({value}, 5, 1), '')) = 0)"


def rule_drops(rule: Rule, match: str, captured: str) -> str:
    tests = []
    for a in rule.allow:
        target = captured if a.source.startswith("^") else match
        tests.append(same_letter(target) if "\\1" in a.source else f"regexp_matches({target}, {re2(a)})")
    if rule.min_entropy is not None:
        tests.append(f"{entropy(captured)} < {rule.min_entropy}")
    return "(" + " or ".join(tests) + ")" if tests else "false"


def credential_hits() -> str:
    parts = [
        f"select * from ({every_match(PLANTED, 'doc_id', r.pattern, f'{lit(r.id)} as rule, {lit(r.label)} as label', group=r.group)}) "
        f"where not {rule_drops(r, 'm', 'c')}"
        for r in CREDENTIALS
    ]
    return " union all ".join(parts)


# --- redaction ----------------------------------------------------------------

_AWS_SECRET = (
    r"""((?:aws_secret_access_key|secret_?key|SECRET_?KEY)[SP]*[=:][SP]*["']?)[A-Za-z0-9/+=]{40}(["']?[SP])"""
).replace("SP", _SPACES)


def redaction_step(rule: Rule, policy: Policy) -> tuple[str, str, str]:
    """SQL for the parts of t, its captures, and the text after the rule.

    Every new token is led by chr(3).
    """
    token = rule.token
    if rule.id == "aws-secret-key":
        done = f"regexp_replace(t, {lit(_AWS_SECRET)}, '\\1' || chr(3) || {lit(token)} || '\\2', 'g')"
        return "[t]", "[t]", done
    p = re2(rule.pattern)
    parts = f"string_split(regexp_replace(t, {p}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
    m, gap = "split_part(parts[i], chr(2), 1)", "split_part(parts[i], chr(2), 2)"
    captured = f"coalesce(cs[i - 1], {m})" if rule.group else m
    drops = [rule_drops(rule, m, captured)]
    if policy.allow_strings:
        drops.append(f"{m} in ({', '.join(lit(s) for s in policy.allow_strings)})")
    drops += [f"regexp_matches({m}, {re2(a)})" for a in policy.allow_patterns]
    dropped = "(" + " or ".join(drops) + ")"
    if rule.context:
        w = rule.window
        at = lambda e: e.replace("parts[i]", "parts[cast(e as int)]").replace("cs[i - 1]", "cs[cast(e as int) - 1]")
        left = f"right(replace(array_to_string(parts[1:cast(e as int)-1], ''), chr(2), ''), {w})"
        right = f"left(replace({at(gap)} || acc, chr(3), ''), {w})"
        region = f"lower({left} || {at(m)} || {right})"
        near = "(" + " or ".join(f"contains({region}, {lit(word)})" for word in rule.context) + ")"
        piece = f"case when not {at(dropped)} and {near} then chr(3) || {lit(token)} else {at(m)} end || {at(gap)} || acc"
        order = "list_transform(list_reverse(range(2, len(parts) + 1)), lambda i: cast(i as varchar))"
        done = f"parts[1] || list_reduce({order}, lambda acc, e: {piece}, '')"
    else:
        done = (
            f"parts[1] || array_to_string(list_transform(range(2, len(parts) + 1), lambda i: "
            f"case when {dropped} then {m} else chr(3) || {lit(token)} end || {gap}), '')"
        )
    return parts, f"regexp_extract_all(t, {p}, {rule.group})", done


def redacted(relation: str, keys: str, policy: Policy, counts: bool = False) -> str:
    """keys, t and, per rule, the number of replacements n0, n1, …"""
    sql = f"select {keys}, text as t from {relation}"
    carried = ""
    for i, rule in enumerate(policy.rules):
        parts, captures, done = redaction_step(rule, policy)
        cut = f"(select {keys}{carried}, t, {parts} as parts, {captures} as cs from ({sql}))"
        counted = f", length(s) - length(replace(s, chr(3), '')) as n{i}" if counts else ""
        sql = f"select {keys}{carried}{counted}, replace(s, chr(3), '') as t from (select {keys}{carried}, {done} as s from {cut})"
        if counts:
            carried += f", n{i}"
    return sql


def redacted_digest(policy: Policy) -> str:
    return f"select doc_id, {digest('t')} from ({redacted(PLANTED, 'doc_id', policy)})"


# --- usage --------------------------------------------------------------------


def num(j: str, path: str) -> str:
    return f"(case when json_type({j}, '$.{path}') in ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') then cast(json_extract_string({j}, '$.{path}') as double) else 0.0 end)"


def txt(j: str, path: str) -> str:
    return f"(case when json_type({j}, '$.{path}') = 'VARCHAR' then json_extract_string({j}, '$.{path}') end)"


def is_obj(j: str, path: str) -> str:
    return f"coalesce(json_type({j}, '$.{path}') = 'OBJECT', false)"


def first_of(*values: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({v}, 0.0)" for v in values) + ")"


COUNTS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "thinking_tokens")


def openai_fields(j: str, at: str) -> list[str]:
    f = lambda p: num(j, f"{at}.{p}")
    return [
        first_of(f("input_tokens"), f("prompt_tokens")),
        first_of(f("output_tokens"), f("completion_tokens")),
        first_of(f("cache_read_input_tokens"), f("input_tokens_details.cached_tokens"), f("prompt_tokens_details.cached_tokens")),
        f"nullif({f('cache_creation_input_tokens')}, 0.0)",
        first_of(f("thinking_tokens"), f("reasoning_tokens"), f("output_tokens_details.reasoning_tokens"), f("completion_tokens_details.reasoning_tokens")),
    ]


def gemini_fields(j: str, at: str) -> list[str]:
    f = lambda p: num(j, f"{at}.{p}")
    prompt, cached = f("promptTokenCount"), f("cachedContentTokenCount")
    return [
        f"greatest(0.0, {prompt} - {cached})",
        f"coalesce(nullif({f('candidatesTokenCount')}, 0.0), greatest(0.0, {f('totalTokenCount')} - {prompt}))",
        cached,
        "null",
        f("thoughtsTokenCount"),
    ]


def start_fields(j: str) -> list[str]:
    f = lambda p: num(j, f"message.usage.{p}")
    return [f("input_tokens"), "null", f("cache_read_input_tokens"), f("cache_creation_input_tokens"),
            f"coalesce({first_of(f('thinking_tokens'), f('reasoning_tokens'))}, 0.0)"]


def json_usage(relation: str) -> str:
    j = "j"
    own, nested = openai_fields(j, "usage"), openai_fields(j, "response.usage")
    flat, wrapped = gemini_fields(j, "usageMetadata"), gemini_fields(j, "response.usageMetadata")
    cols = []
    for i, name in enumerate(COUNTS):
        gem = f"case when {is_obj(j, 'usageMetadata')} then {flat[i]} when {is_obj(j, 'response.usageMetadata')} then {wrapped[i]} end"
        cols.append(
            f"cast(coalesce({gem}, case when {is_obj(j, 'response.usage')} then {nested[i]} end, case when {is_obj(j, 'usage')} then {own[i]} end, 0.0) as bigint) as {name}"
        )
    model = "coalesce(" + ", ".join(f"nullif({txt(j, p)}, '')" for p in ("model", "modelVersion", "response.model", "response.modelVersion")) + ")"
    reasons = lambda path, field: (
        f"array_to_string(list_filter(list_transform(cast(json_extract(j, '$.{path}') as json[]), "
        f"lambda x: case when json_type(x, '$.{field}') = 'VARCHAR' then json_extract_string(x, '$.{field}') end), lambda y: y is not null), ',')"
    )
    finish = (
        f"case when nullif({txt(j, 'stop_reason')}, '') is not null then {txt(j, 'stop_reason')} "
        f"when json_type(j, '$.choices') = 'ARRAY' then {reasons('choices', 'finish_reason')} "
        f"when json_type(j, '$.candidates') = 'ARRAY' then {reasons('candidates', 'finishReason')} else '' end"
    )
    return (
        f"select capture_id, {', '.join(cols)}, {model} as model, {finish} as finish_reasons, false as stream "
        f"from (select capture_id, {SAFE_JSON.format('response_body')} as j from {relation} where not response_is_streaming)"
    )


def sse_events(relation: str, extra: str = "") -> str:
    """capture_id, pos, j of every JSON object in the event streams."""
    lines = f"(select capture_id{extra}, unnest(string_split(response_body, chr(10))) as line, generate_subscripts(string_split(response_body, chr(10)), 1) as pos from {relation})"
    data = f"(select *, trim(substr(ltrim(line), 6)) as data from {lines} where ltrim(line) like 'data:%')"
    return f"(select capture_id{extra}, pos, try_cast(data as json) as j from {data} where data like '{{%' and try_cast(data as json) is not null)"


def last(value: str) -> str:
    return f"arg_max({value}, pos) filter (where {value} is not null)"


def sse_fold(updates: list[str], model: str, finish: str) -> str:
    inner = ", ".join(f"{u} as u{i}" for i, u in enumerate(updates)) + f", {model} as um, {finish} as uf"
    outer = ", ".join(f"cast(coalesce({last(f'u{i}')}, 0.0) as bigint) as {n}" for i, n in enumerate(COUNTS))
    return inner, f"{outer}, {last('um')} as model, coalesce({last('uf')}, '') as finish_reasons"


def sse_usage(relation: str) -> str:
    j = "j"
    start, own, nested = start_fields(j), openai_fields(j, "usage"), openai_fields(j, "response.usage")
    flat, wrapped = gemini_fields(j, "usageMetadata"), gemini_fields(j, "response.usageMetadata")
    is_start = f"({txt(j, 'type')} = 'message_start' and {is_obj(j, 'message.usage')})"
    updates = [
        f"coalesce(case when {is_obj(j, 'usageMetadata')} then {flat[i]} when {is_obj(j, 'response.usageMetadata')} then {wrapped[i]} end, "
        f"case when {is_obj(j, 'usage')} then {own[i]} when {is_obj(j, 'response.usage')} then {nested[i]} end, "
        f"case when {is_start} then {start[i]} end)"
        for i in range(5)
    ]
    model = "coalesce(" + ", ".join(f"nullif({txt(j, p)}, '')" for p in ("modelVersion", "model", "response.modelVersion", "response.model")) + f", case when {txt(j, 'type')} = 'message_start' then nullif({txt(j, 'message.model')}, '') end)"
    finish = f"coalesce({txt(j, 'candidates[0].finishReason')}, {txt(j, 'choices[0].finish_reason')}, case when {txt(j, 'type')} = 'message_delta' then nullif({txt(j, 'delta.stop_reason')}, '') end)"
    inner, outer = sse_fold(updates, model, finish)
    streams = f"(select * from {relation} where response_is_streaming)"
    return (
        f"select capture_id, {outer}, true as stream from (select capture_id, pos, {inner} from {sse_events(streams)}) group by capture_id"
    )


def provider_usage() -> str:
    j = "j"
    start, own, gem = start_fields(j), openai_fields(j, "usage"), gemini_fields(j, "usageMetadata")
    is_start = f"(provider = 'anthropic' and {txt(j, 'type')} = 'message_start' and {is_obj(j, 'message.usage')})"
    is_delta = f"(provider = 'anthropic' and {txt(j, 'type')} = 'message_delta' and {is_obj(j, 'usage')})"
    is_chat = f"(provider in ('openai', 'chatgpt') and {is_obj(j, 'usage')} and json_type(j, '$.choices') = 'ARRAY')"
    is_gem = f"(provider = 'gemini' and {is_obj(j, 'usageMetadata')})"
    f = lambda p: num(j, f"usage.{p}")
    delta = ["null", f("output_tokens"), "null", "null", first_of(f("thinking_tokens"), f("reasoning_tokens"))]
    updates = [
        f"case when {is_start} then {start[i]} when {is_delta} then {delta[i]} when {is_chat} then {own[i]} when {is_gem} then {gem[i]} end"
        for i in range(5)
    ]
    model = f"case when provider = 'anthropic' and {txt(j, 'type')} = 'message_start' then nullif({txt(j, 'message.model')}, '') when provider = 'gemini' then nullif({txt(j, 'modelVersion')}, '') end"
    finish = f"case when provider = 'anthropic' and {txt(j, 'type')} = 'message_delta' then nullif({txt(j, 'delta.stop_reason')}, '') when provider in ('openai', 'chatgpt') then {txt(j, 'choices[0].finish_reason')} when provider = 'gemini' then {txt(j, 'candidates[0].finishReason')} end"
    inner, outer = sse_fold(updates, model, finish)
    total = " + ".join(COUNTS)
    return (
        f"select * from (select capture_id, {outer} from (select capture_id, provider, pos, {inner} from {sse_events(CAPTURES, ', provider')}) group by capture_id) where {total} > 0"
    )


USAGE = f"({json_usage(CAPTURES)} union all {sse_usage(CAPTURES)})"
MODEL_ROWS = "(values " + ", ".join(f"({i}, {lit(k)}, {l}, {a}::double, {b}::double)" for i, (k, l, a, b) in enumerate(MODELS)) + ") as mt(ord, key, lim, pin, pout)"


def priced(relation: str) -> str:
    """The relation with key, lim, pin, pout of its model."""
    hits = (
        f"select name, arg_min(key, ord) as key, arg_min(lim, ord) as lim, arg_min(pin, ord) as pin, arg_min(pout, ord) as pout "
        f"from (select distinct model as name from {relation}) join {MODEL_ROWS} on contains(replace(name, '.', '-'), replace(key, '.', '-')) group by name"
    )
    return f"(select r.*, key, lim, pin, pout from {relation} r left join ({hits}) h on r.model = h.name)"


_read = "case " + " ".join(f"when starts_with(key, '{p}') then {r}" for p, r, _ in CACHE_SHARES) + " else 0.0 end"
_write = "case " + " ".join(f"when starts_with(key, '{p}') then {w}" for p, _, w in CACHE_SHARES) + " else 0.0 end"
COST = (
    f"case when key is not null then floor((input_tokens * pin + output_tokens * pout + cache_read_tokens * pin * {_read}::double "
    f"+ cache_write_tokens * pin * {_write}::double) / 1000000.0::double * 1000000.0::double + 0.5::double) / 1000000.0::double end"
)


def fixed(x: str, digits: int) -> str:
    """Half-up decimal display of a double, settled on its exact binary value."""
    s = 10**digits
    hi = f"(({x}) * 134217729.0::double - (({x}) * 134217729.0::double - ({x})))"
    base = f"cast(floor(({x}) * {s}) as bigint)"
    up = f"(({hi} * {2 * s}::double - ({base} * 2 + 1)::double) + (({x}) - {hi}) * {2 * s}::double >= 0)"
    n = f"({base} + case when {up} then 1 else 0 end)"
    return f"(cast({n} // {s} as varchar) || '.' || lpad(cast({n} % {s} as varchar), {digits}, '0'))"


# --- sessions -----------------------------------------------------------------

FILES = (
    "(select *, regexp_replace(coalesce(nullif(source, ''), 'unknown'), '[^a-zA-Z0-9_-]', '_', 'g') || coalesce('_' || session_id, '') || '_' || "
    "cast(written_ms as varchar) || '-' || lpad(cast(row_number() over (order by written_ms, capture_id) - 1 as varchar), 6, '0') || '.json' as file, "
    "strftime(make_timestamp(written_ms * 1000), '%Y-%m-%dT%H:%M:%S') || '.000Z' as ts "
    f"from {CAPTURES})"
)
_parts = "string_split(replace(file, '.json', ''), '_')"
TAGGED = f"(select *, case when len({_parts}) >= 3 and regexp_full_match({_parts}[2], '[a-f0-9]{{8}}') then {_parts}[2] end as file_session from {FILES})"
BODY = "(select *, try_cast(request_body as json) as j from {})"
SYSTEM = f"""case provider
  when 'anthropic' then coalesce({txt('j', 'system')}, {txt('j', 'system[0].text')})
  when 'gemini' then {txt('j', 'systemInstruction.parts[0].text')}
  else case when json_extract_string(j, '$.messages[0].role') = 'developer' then {txt('j', 'messages[0].content')} end end"""
FIRST_USER = (
    "(list_filter(cast(json_extract(j, '$.messages') as json[]), lambda x: json_extract_string(x, '$.role') = 'user'))[1]"
)
# Tools of the three request shapes: name, description, parameters.
TOOLS = """(values ('anthropic', 0, 'read_file', 'Read a file from disk', 2), ('anthropic', 1, 'bash', '', 0),
  ('openai', 0, 'search', 'Search the code base', 1), ('openai', 1, '?', '', 0),
  ('gemini', 0, 'get_weather', 'Weather now', 2), ('gemini', 1, 'noop', '', 0)) as tools(shape, tool_ord, name, description, param_count)"""


def tool_rows() -> str:
    listed = "(select capture_id, provider, j, case provider when 'gemini' then json_extract(j, '$.tools[0].functionDeclarations') else json_extract(j, '$.tools') end as tools from " + BODY.format(CAPTURES) + ")"
    each = f"(select capture_id, provider, unnest(cast(tools as json[])) as t, unnest(range(cast(json_array_length(tools) as bigint))) as tool_ord from {listed})"
    schema = "case provider when 'anthropic' then json_extract(t, '$.input_schema.properties') else json_extract(t, '$.parameters.properties') end"
    return (
        "select capture_id, cast(tool_ord as int) as tool_ord, coalesce(json_extract_string(t, '$.name'), '?') as name, "
        "coalesce(json_extract_string(t, '$.description'), '') as description, "
        f"cast(coalesce(len(json_keys({schema})), 0) as int) as param_count from {each}"
    )


def overhead() -> str:
    tools = f"(select capture_id, sum(cast(ceil(length(description) / 4.0) as bigint)) as tool_tokens from ({tool_rows()}) group by capture_id)"
    base = (
        f"(select capture_id, cast(ceil(length(coalesce({SYSTEM}, '')) / 4.0) as bigint) as system_tokens, "
        f"cast(ceil(length(coalesce(json_extract_string({FIRST_USER}, '$.content'), '')) / 4.0) as bigint) as first_user_tokens from {BODY.format(CAPTURES)})"
    )
    share = "((system_tokens + tool_tokens)::double / (system_tokens + tool_tokens + first_user_tokens)::double * 100.0::double)"
    return (
        f"select capture_id, system_tokens, cast(tool_tokens as bigint) as tool_tokens, first_user_tokens, "
        f"case when system_tokens + tool_tokens > 0 and first_user_tokens > 0 then {fixed(share, 1)} end as overhead_pct from {base} join {tools} using (capture_id)"
    )


def ledger() -> str:
    used = f"(select capture_id, {', '.join(COUNTS)} from {USAGE})"
    joined = (
        f"(select c.*, u.* exclude (capture_id), coalesce(json_extract_string(try_cast(c.request_body as json), '$.model'), '?') as model from {CAPTURES} c join {used} u using (capture_id))"
    )
    rows = f"(select *, {COST} as cost_usd from {priced(joined)})"
    short = lambda n: f"case when {n} >= 1000 then replace({fixed(f'({n})::double / 1000.0::double', 1)} || 'k', '.0k', 'k') else cast({n} as varchar) end"
    return (
        "select capture_id, session_id, strftime(make_timestamp(written_ms * 1000), '%H:%M:%S') as time, "
        "coalesce(nullif(source, ''), '?') as source, model, response_status as status, "
        f"case when total_ms < 1000 then cast(total_ms as varchar) || 'ms' else {fixed('total_ms::double / 1000.0::double', 1)} || 's' end as latency, "
        "input_tokens as tokens_in, output_tokens as tokens_out, "
        f"case when input_tokens = 0 and output_tokens = 0 then '?/?' else {short('input_tokens')} || '/' || {short('output_tokens')} end as tokens, "
        f"cost_usd, case when cost_usd is null then '$?' when cost_usd < 0.01 then '$' || {fixed('cost_usd', 3)} else '$' || {fixed('cost_usd', 2)} end as cost "
        f"from {rows}"
    )


def totals(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return (
        f"select {lead}count(distinct nullif(session_id, '')) as sessions, count(*) as requests, sum(tokens_in) as tokens_in, sum(tokens_out) as tokens_out, "
        "cast(sum(cast(cost_usd as decimal(18,6))) as double) as cost_usd, "
        "cast(sum(case when cost <> '$?' then cast(substr(cost, 2) as decimal(18,3)) end) as double) as cost_shown "
        f"from ({ledger()})" + (f" group by {by}" if by else "")
    )


# --- routing ------------------------------------------------------------------


def routed() -> str:
    segment, rest = "regexp_extract(path, '^/([^/]+)(/.*)?$', 1)", "regexp_extract(path, '^/([^/]+)(/.*)?$', 2)"
    # The planted paths hold one escape that does not decode.
    decoded = "case when contains(seg, '%zz') then seg else url_decode(seg) end"
    api = ", ".join(lit(s) for s in API_SEGMENTS)
    base = f"(select *, {segment} as seg, {rest} as rest from {LOG})"
    tagged = f"(select *, {decoded} as src, rest <> '' and seg not in ({api}) as tag from {base})"
    ok = "(tag and not contains(src, '/') and not contains(src, chr(92)) and not contains(src, '..'))"
    session = "regexp_extract(rest, '^/([a-f0-9]{8})(/.*)$', 1)"
    return (
        f"(select *, case when {ok} then src end as source, case when {ok} then nullif({session}, '') end as session_id, "
        f"case when {ok} and {session} <> '' then substr(rest, 10) when {ok} then rest else path end as clean_path from {tagged})"
    )


def classified(headers: str = "headers", relation: str | None = None) -> str:
    p = "clean_path"
    h = lambda n: f"coalesce({headers}['{n}'], '') <> ''"
    tests = [
        (f"regexp_matches({p}, '^/(api|backend-api|codex)/')", "chatgpt", "chatgpt-backend"),
        (f"contains({p}, '/v1/messages')", "anthropic", "anthropic-messages"),
        (f"contains({p}, '/v1/complete')", "anthropic", "unknown"),
        (h("anthropic-version"), "anthropic", "unknown"),
        (f"regexp_matches({p}, '/v1[^/]*/projects/[^/]+/locations/[^/]+/publishers/google/models/')", "vertex", "gemini"),
        (f"contains({p}, ':generateContent') or contains({p}, ':streamGenerateContent') or regexp_matches({p}, '/v1(beta|alpha)/models/') or contains({p}, '/v1internal:') or {h('x-goog-api-key')}", "gemini", "gemini"),
        (f"contains({p}, '/responses')", "openai", "responses"),
        (f"contains({p}, '/chat/completions')", "openai", "chat-completions"),
        (f"regexp_matches({p}, '/(models|embeddings)')", "openai", "unknown"),
        (f"starts_with(coalesce({headers}['authorization'], ''), 'Bearer sk-')", "openai", "unknown"),
    ]
    case = lambda k: "case " + " ".join(f"when {t[0]} then '{t[k]}'" for t in tests) + " else 'unknown' end"
    return f"(select *, {case(1)} as provider, {case(2)} as api_format from {relation or routed()})"


def targets() -> str:
    local = "peer in ('127.0.0.1', '::1', '::ffff:127.0.0.1')"
    seen = f"(select *, case when {local} then headers['x-target-url'] end as over from {routed()})"
    u, qs = UPSTREAMS, "coalesce(query, '')"
    loc = "regexp_extract(clean_path, '/locations/([^/]+)/', 1)"
    url = f"""case
      when over is not null and starts_with(over, 'http') then over
      when over is not null then over || clean_path || {qs}
      when provider = 'chatgpt' and regexp_matches(clean_path, '^/(api|backend-api)/') then '{u['chatgpt']}' || clean_path || {qs}
      when provider = 'chatgpt' then '{u['chatgpt']}/backend-api' || clean_path || {qs}
      when provider = 'anthropic' then '{u['anthropic']}' || clean_path || {qs}
      when provider = 'gemini' and contains(clean_path, '/v1internal') then '{u['gemini_code_assist']}' || clean_path || {qs}
      when provider = 'gemini' then '{u['gemini']}' || clean_path || {qs}
      when provider = 'vertex' and {loc} not in ('', 'global') then 'https://' || {loc} || '-aiplatform.googleapis.com' || clean_path || {qs}
      when provider = 'vertex' then '{u['vertex']}' || clean_path || {qs}
      when clean_path = '/responses' then '{u['openai']}/v1/responses' || {qs}
      else '{u['openai']}' || clean_path || {qs} end"""
    return f"select event_id, provider, {url} as target_url from {classified('headers', seen)}"


# --- reversible ---------------------------------------------------------------

ROWS = (
    "(select conv_id * 1000 + turn as row_id, case when conv_id % 10 <> 9 then 's' || cast(conv_id % 50 as varchar) end as session_id, "
    f"conv_id * 1000 + turn as seq, text from {MESSAGES})"
)


def chain_hits(rows: str) -> str:
    """row_id, session_id, rule_ord, rule, i, original of a chain of plain rules."""
    policy = compile_policy(q.PSEUDONYM_POLICY)
    out, text = [], "text"
    for i, rule in enumerate(policy.rules):
        out.append(
            f"select row_id, coalesce(session_id, '__default__') as session_id, {i} as rule_ord, {lit(rule.id)} as rule, "
            f"unnest(regexp_extract_all({text}, {re2(rule.pattern)})) as original, "
            f"generate_subscripts(regexp_extract_all({text}, {re2(rule.pattern)}), 1) as i from {rows}"
        )
        text = f"regexp_replace({text}, {re2(rule.pattern)}, '[X_1]', 'g')"
    return "(" + " union all ".join(out) + ")"


def dictionary(rows: str) -> str:
    first = (
        f"select session_id, original, arg_min(rule, row_id * 1000000 + rule_ord * 10000 + i) as rule, min(row_id * 1000000 + rule_ord * 10000 + i) as place from {chain_hits(rows)} group by all"
    )
    return (
        "(select session_id, original, rule, '[' || replace(upper(rule), '-', '_') || '_' || cast(row_number() over (partition by session_id, rule order by place) as varchar) || ']' as placeholder "
        f"from ({first}))"
    )


def spread_dictionary(rows: str) -> str:
    """The same originals, numbered per slice in steps of as many slices as there are."""
    slot = f"cast('0x' || substr(md5(original), 1, 6) as bigint) % {q.SLICES}"
    rank = "row_number() over (partition by session_id, rule, slot order by place)"
    first = (
        "select session_id, original, arg_min(rule, row_id * 1000000 + rule_ord * 10000 + i) as rule, "
        f"min(row_id * 1000000 + rule_ord * 10000 + i) as place, {slot} as slot from {chain_hits(rows)} group by all"
    )
    return (
        f"(select session_id, original, rule, '[' || replace(upper(rule), '-', '_') || '_' || cast(({rank} - 1) * {q.SLICES} + slot + 1 as varchar) || ']' as placeholder "
        f"from ({first}))"
    )


def pseudonymised(rows: str, book: str) -> str:
    """Each rule's matches replaced one after the other, by the placeholder of the original."""
    policy = compile_policy(q.PSEUDONYM_POLICY)
    ctes = [
        f"book as (select * from {book})",
        "maps as (select session_id, map(list(original), list(placeholder)) as m from book group by session_id)",
        f"r0 as (select row_id, text as t, coalesce(m, map([], [])) as m from {rows} r left join maps on coalesce(r.session_id, '__default__') = maps.session_id)",
    ]
    for i, rule in enumerate(policy.rules):
        p = re2(rule.pattern)
        marked = f"string_split(regexp_replace(t, {p}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
        ctes.append(
            f"r{i + 1} as (select row_id, m, parts[1] || array_to_string(list_transform(parts[2:], lambda x: m[split_part(x, chr(2), 1)] || split_part(x, chr(2), 2)), '') as t "
            f"from (select row_id, m, {marked} as parts from r{i}))"
        )
    return f"with {', '.join(ctes)} select row_id, {digest('t')} from r{len(policy.rules)}"


def sse_delta_rows(relation: str) -> str:
    lines = f"(select capture_id, unnest(string_split(response_body, chr(10))) as line, generate_subscripts(string_split(response_body, chr(10)), 1) - 1 as line_no from {relation} where response_is_streaming)"
    j = "try_cast(substr(line, 7) as json)"
    delta = f"coalesce(json_extract_string({j}, '$.delta.text'), json_extract_string({j}, '$.choices[0].delta.content'), json_extract_string({j}, '$.candidates[0].content.parts[0].text'))"
    return f"(select * from (select capture_id, line_no, {delta} as delta from {lines} where line like 'data: %') where delta is not null)"


# --- JSON bodies --------------------------------------------------------------

_STRING = r'"(?:[^"\\]|\\.)*"'


def json_redacted(relation: str, keys: str, column: str, rules: tuple[Rule, ...], scope: str) -> str:
    """String literals redacted one by one; `scope` tells which literal i of `parts` is covered.

    The bodies escape only quotes, backslashes and newlines.
    """
    plain = "replace(replace(replace(replace(substr(m, 2, length(m) - 2), chr(92) || chr(92), chr(4)), chr(92) || chr(34), chr(34)), chr(92) || 'n', chr(10)), chr(4), chr(92))"
    marked = f"string_split(regexp_replace({column}, {lit(_STRING)}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
    each = (
        f"(select {keys}, i, split_part(parts[i], chr(2), 1) as m, split_part(parts[i], chr(2), 2) as gap, parts[i-1] as prev, parts "
        f"from (select {keys}, parts, unnest(range(2, len(parts) + 1)) as i from (select {keys}, {marked} as parts from {relation})))"
    )
    leaves = f"(select {keys}, i, m, gap, {scope} as covered, {plain} as text from {each})"
    done = redacted(leaves, f"{keys}, i, m, gap, covered, text", Policy(rules))
    escaped = "chr(34) || replace(replace(replace(t, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n') || chr(34)"
    heads = f"(select {keys}, string_split(regexp_replace({column}, {lit(_STRING)}, chr(1) || '\\0' || chr(2), 'g'), chr(1))[1] as head from {relation})"
    return (
        f"(select {keys}, head || string_agg(case when covered and t <> text then {escaped} else m end || gap, '' order by i) as body "
        f"from ({done}) join {heads} using ({keys}) group by {keys}, head)"
    )


NOT_KEY = "not regexp_matches(gap, '^\\s*:')"


def oracle_queries() -> dict[str, str]:
    names = lambda m: f"array_to_string(list_sort(list_filter(map_keys({m}), lambda k: lower(k) not in ({', '.join(lit(h) for h in SENSITIVE_HEADERS)}))), ',')"
    o: dict[str, str] = {}
    o["src_session_from_filename"] = f"select capture_id, file_session from {TAGGED}"
    o["snk_file_keys"] = f"select capture_id, file from {FILES}"
    o["snk_retention"] = (
        f"with t as (select * from {TAGGED}), keep as (select file_session from t where file_session is not null group by 1 "
        f"order by max(written_ms) desc, min(file) limit {q.RETAINED}) "
        "select capture_id, file_session from t where file_session is null or file_session in (select file_session from keep)"
    )
    o["snk_table_retention"] = o["snk_retention"]
    o["src_capture_files"] = (
        "select '/v1/x/' || capture_id as path, session_id, json_extract_string(try_cast(request_body as json), '$.model') as model, 'accept' as headers, "
        f"cast(strlen(response_body) as bigint) as response_bytes, total_ms, {digest('response_body')} from {CAPTURES}"
    )
    o["src_capture_stream"] = o["src_capture_files"]
    o["src_request_ingest"] = (
        f"select event_id, case when try_cast(body as json) is not null then body end as request_body, cast(strlen(body) as bigint) as request_bytes from {LOG} where method = 'POST'"
    )
    n = "event_id"
    sent, seen, end = f"(case when {n} % 4 <> 0 then {n} + 1.5::double end)", f"(case when {n} % 5 <> 0 then {n} + value end)", f"({n} + value * 3)"
    first, half = f"coalesce({seen}, {end})", lambda x: f"cast(floor({x} + 0.5::double) as bigint)"
    o["snk_capture_assembly"] = (
        f"select event_id as request_id, {names('headers')} as request_headers, 'server' as response_headers, cast(strlen(body) as bigint) as response_bytes, "
        f"{half(f'greatest(0.0::double, coalesce({sent}, {first}) - {n}::double)')} as send_ms, {half(f'greatest(0.0::double, {first} - coalesce({sent}, {n}::double))')} as wait_ms, "
        f"{half(f'({end} - {first})')} as receive_ms, {half(f'({end} - {n}::double)')} as total_ms from {LOG} where method = 'POST'"
    )
    came = lambda x: f"case when request_id % 11 <> 3 then {x} end as {x}"
    o["snk_capture_assembly_stream"] = (
        f"select request_id, request_headers, {', '.join(map(came, ('response_headers', 'response_bytes', 'send_ms', 'wait_ms', 'receive_ms', 'total_ms')))} "
        f"from ({o['snk_capture_assembly']})"
    )
    o["hdr_scrub"] = f"select event_id, {names('headers')} as kept from {LOG}"
    o["route_source"] = f"select event_id, source, session_id, clean_path from {routed()}"
    o["route_classify"] = f"select provider, api_format, count(*) as requests from {classified()} group by all"
    o["route_target"] = targets()
    o["route_trust_gate"] = (
        f"select peer, count(*) filter (where headers['x-target-url'] is not null and peer in ('127.0.0.1', '::1', '::ffff:127.0.0.1')) as honoured, 0 as when_off from {LOG} group by peer"
    )
    o["capture_filter"] = f"select capture_id, session_id from {CAPTURES} where source = 'aider'"
    o["recent_filter"] = f"select event_id from events where ts >= timestamp '{q.NOW}' - interval 36 hour"
    usage_cols = f"capture_id, {', '.join(COUNTS)}, model, finish_reasons, stream"
    o["usage_json"] = f"select {usage_cols} from ({json_usage(CAPTURES)})"
    o["usage_sse"] = f"select {usage_cols} from ({sse_usage(CAPTURES)})"
    o["usage_body_kind"] = f"select provider, regexp_matches(response_body, '(^|\\n)\\s*data:') as sse, count(*) as bodies from {CAPTURES} group by all"
    o["usage_provider_sse"] = provider_usage()
    first_id = f"(select capture_id, arg_min(id, pos) as id from (select capture_id, pos, coalesce(json_extract_string(j, '$.response.id'), case when {txt('j', 'type')} in ('response.created', 'response.completed') then json_extract_string(j, '$.id') end) as id from {sse_events('(select * from ' + CAPTURES + ' where response_is_streaming)')}) where id is not null group by 1)"
    o["response_ids"] = (
        f"select capture_id, coalesce(json_extract_string(j, '$.id'), json_extract_string(j, '$.response_id'), s.id) as response_id "
        f"from (select capture_id, try_cast(response_body as json) as j from {CAPTURES}) left join {first_id} s using (capture_id)"
    )
    o["response_ids_once"] = (
        f"select response_id, case when response_id is null then count(*) else 1 end as captures from ({o['response_ids']}) group by response_id"
    )
    o["context_limit"] = (
        f"select capture_id, model, input_tokens, case when model is not null then coalesce(lim, 128000) end as context_limit, "
        f"round(input_tokens * 100.0::double / coalesce(lim, 128000), 4) as used_pct from {priced(USAGE)}"
    )
    o["cost_ledger"] = f"select capture_id, key as model_key, {COST} as cost_usd from {priced(USAGE)}"
    asked = f"(select json_extract_string(request_body::json, '$.model') as model from {CAPTURES})"
    o["models_by_table"] = f"select distinct model, key as model_key, coalesce(lim, 0) as context_limit from {priced(asked)}"
    o["known_models"] = f"select mt.key as model_key, count(p.model) as calls from {MODEL_ROWS} left join {priced(asked)} p on p.key = mt.key group by mt.key"
    return {**o, **_text_queries(), **_session_queries(), **_scan_queries(), **_redaction_queries(), **_reversible_queries()}


def _text_queries() -> dict[str, str]:
    tokens = "cast(ceil(length(text) / 4.0) as bigint)"
    o = {
        "tokens_text_by_lang": (
            f"select lang, source, count(*) as texts, cast(sum({tokens}) as bigint) as tokens, max({tokens}) as largest, "
            f"quantile_disc({tokens}, 0.5) as median from documents group by lang, source"
        )
    }
    said = "(length(" + d.json_string_sql("text") + ") + 23)"
    # Bytes of the extra element after stripping, and its images, per shape.
    spare = [len('{"type":"image","_image":true}'), len('{"type":"image_url","_image":true}'),
             len('{"parts":[{"type":"image","_image":true},{"text":"hi"},{"type":"image","_image":true}]}'),
             len('{"type":"tool_result","content":[{"type":"image","_image":true},{"type":"text","text":"ok"}]}'),
             len('{"type":"text","text":"no picture"}'), len('{"content":[{"type":"image","source":{}}],"role":"user"}')]
    images = [1, 1, 2, 1, 0, 0]
    at = lambda xs: f"([{', '.join(map(str, xs))}])[cast(doc_id % 6 as int) + 1]"
    o["tokens_json"] = f"select doc_id, cast(ceil(({said} + {at(spare)} + 3) / 4.0) as bigint) + {at(images)} * 1600 as tokens from documents"
    o["tokens_images"] = f"select doc_id, {at(images)} as images from documents"
    return o


def _session_queries() -> dict[str, str]:
    o = {}
    t = f"with t as (select * from {TAGGED}) "
    o["session_list"] = (
        t + "select session_id, arg_min(coalesce(nullif(source, ''), '?'), file) as source, arg_min(provider, file) as provider, count(*) as requests, "
        "arg_min(ts, file) as first_time, arg_max(ts, file) as last_time from t where session_id is not null group by session_id"
    )
    o["session_latest_id"] = t + "select arg_max(session_id, file) as session_id from t where session_id is not null"
    o["session_latest"] = (
        t + "select capture_id, session_id from t where source = 'aider' and session_id is not distinct from "
        "(select session_id from t where source = 'aider' order by file desc limit 1)"
    )
    o["session_load"] = t + "select capture_id, file from t where session_id = '00000003'"
    o["system_prompts"] = f"select capture_id, provider, {digest('s')} from (select capture_id, provider, {SYSTEM} as s from {BODY.format(CAPTURES)})"
    o["tool_defs"] = tool_rows()
    o["first_user_message"] = f"select capture_id, {digest('s')} from (select capture_id, json_extract_string({FIRST_USER}, '$.content') as s from {BODY.format(CAPTURES)})"
    o["context_overhead"] = overhead()
    o["monitor_rows"] = ledger()
    o["monitor_totals"] = totals()
    o["monitor_totals_by_source"] = totals("source")
    o["monitor_windows"] = (
        "select written_ms // 21600000 * 21600 as window_start, l.source, count(*) as requests, cast(sum(tokens_in) as bigint) as tokens_in, "
        "cast(sum(tokens_out) as bigint) as tokens_out, cast(sum(cast(cost_usd as decimal(18,6))) as double) as cost_usd "
        f"from ({ledger()}) l join (select capture_id, written_ms from {CAPTURES}) using (capture_id) group by all"
    )
    n = "cast(ceil(length(text) / 4.0) as bigint)"
    cost = f"floor((({n} * 2) * 3.0::double + {n} * 15.0::double) / 1000000.0::double * 1000000.0::double + 0.5::double) / 1000000.0::double"
    shown = f"case when c < 0.01 then cast({fixed('c', 3)} as decimal(18,3)) else cast({fixed('c', 2)} as decimal(18,3)) end"
    o["monitor_stream"] = (
        f"select count(distinct conv_id) as sessions, count(*) as requests, cast(sum(n * 2) as bigint) as tokens_in, cast(sum(n) as bigint) as tokens_out, "
        f"cast(sum(cast(c as decimal(18,6))) as double) as cost_usd, cast(sum({shown}) as double) as cost_shown "
        f"from (select conv_id, {n} as n, {cost} as c from conversations where role = 'assistant')"
    )
    return o


def _alerts(parts: list[str]) -> str:
    return "(" + " union all ".join(parts) + ")"


def _scan_queries() -> dict[str, str]:
    o = {}
    injection = lambda rel, keys, where="true": [first_match(rel, keys, r.pattern, i, r.id, r.severity, where) for i, r in enumerate(INJECTION)]
    shown = f"pattern, severity, {CUT} as match, off as \"offset\", length(m) as length"
    o["scan_injection"] = f"select doc_id, {shown} from {_alerts(injection(PLANTED, 'doc_id'))}"
    pages = f"(select page_id, html || {pick('page_id', d.HIDDEN_MARKUP)} as text from pages)"
    o["scan_hidden_markup"] = f"select page_id, {shown} from {_alerts(injection(pages, 'page_id'))}"

    def confusion(rel: str, keys: str) -> str:
        tries = _alerts([first_match(rel, keys, p, i, "role_confusion", "medium", "role = 'tool'") for i, p in enumerate(ROLE_CONFUSION)])
        return f"(select * from {tries} qualify row_number() over (partition by {keys} order by rule_ord) = 1)"

    o["scan_role_confusion"] = (
        f"select conv_id, turn as index, role, pattern, {CUT} as match, off as \"offset\", length(m) as length from {confusion(MESSAGES, 'conv_id, turn, role')}"
    )
    u = re2(SUSPICIOUS_UNICODE)
    message = "cast(n as varchar) || ' suspicious Unicode character' || case when n > 1 then 's' else '' end || ' (zero-width, RTL override, etc.)'"

    def unicode(rel: str, keys: str) -> str:
        return (
            f"(select {keys}, 99 as rule_ord, 'suspicious_unicode' as pattern, 'info' as severity, {message} as m, off from "
            f"(select {keys}, len(regexp_extract_all(text, {u})) as n, length(regexp_extract(text, '(?s)\\A(.*?)(?:' || {u} || ')', 1)) as off from {rel} where regexp_matches(text, {u})))"
        )

    o["scan_unicode"] = f"select doc_id, severity, m as match, off as \"offset\", 1 as length from {unicode(PLANTED, 'doc_id')}"
    said = f"(select * from {MESSAGES} where role not in ('system', 'developer'))"
    keys = "conv_id, turn, role"
    talk = lambda rel, k: _alerts(injection(rel, k) + [f"select * from {confusion(rel, k)}", f"select * from {unicode(rel, k)}"])
    size = "case when pattern = 'suspicious_unicode' then 1 else length(m) end as length"
    o["scan_conversations"] = f"select conv_id, turn as index, role, severity, pattern, off as \"offset\", {size} from {talk(said, keys)}"
    messages = (
        "(select capture_id, cast(idx as int) as idx, json_extract_string(msg, '$.role') as role, json_extract_string(msg, '$.content') as text from "
        f"(select capture_id, unnest(cast(json_extract(j, '$.messages') as json[])) as msg, unnest(range(cast(json_array_length(j, '$.messages') as bigint))) as idx from {BODY.format(PLANTED_CAPTURES)}) "
        "where json_extract_string(msg, '$.role') not in ('system', 'developer'))"
    )
    o["scan_request_bodies"] = f"select capture_id, idx as index, role, severity, pattern, off as \"offset\", {size} from {talk(messages, 'capture_id, idx, role')}"
    levels = ", ".join(f"count(*) filter (where severity = '{s}') as {s}" for s in ("high", "medium", "info"))
    o["scan_severity_summary"] = f"select conv_id, {levels} from {talk(said, keys)} group by conv_id"
    docs = _alerts(injection(PLANTED, "doc_id, lang, source") + [f"select * from {unicode(PLANTED, 'doc_id, lang, source')}"])
    o["scan_severity_rollup"] = f"select lang, source, {levels} from {docs} group by rollup (lang, source)"

    hits = f"({credential_hits()})"
    o["cred_scan"] = f"select doc_id, rule, off as \"offset\", length(m) as length, md5(m) as md5 from {hits}"
    o["cred_entropy"] = f"select doc_id, rule, off as \"offset\", round({entropy('c')}, 6) as entropy from {hits}"
    o["cred_inventory"] = f"select rule, label, count(*) as findings, count(distinct doc_id) as rows from {hits} group by rule, label"

    out = f"doc_id, idx as index, severity, pattern, {CUT} as match, off as \"offset\", length(m) as length"

    def every(pairs) -> str:
        return _alerts([every_match(PLANTED, "doc_id", p, f"{i} as idx, '{s}' as severity, '{name}' as pattern") for i, p, s, name in pairs])

    banned = [(i, Pattern(quote(b), "i"), "high", "ban_substring") for i, b in enumerate(BANNED)]
    o["ban_substrings"] = f"select {out} from {every(banned)}"
    o["ban_substrings_exact_case"] = f"select {out} from {every([(i, Pattern(quote(b)), 'high', 'ban_substring') for i, b in enumerate(['DAN:', 'the '])])}"
    valid = [(i, Pattern(p, "i"), "medium", f"regex_{i}") for i, p in enumerate(q.CUSTOM_PATTERNS) if p != "(unclosed"]
    o["regex_blocked"] = f"select {out} from {every(valid)}"
    required = [(i, Pattern(p, "i"), "medium", f"regex_{i}") for i, p in enumerate(q.REQUIRED_PATTERNS)]
    o["regex_required"] = " union all ".join(
        f"select doc_id, {i} as index, 'medium' as severity, '{name}' as pattern, {lit(f'(required pattern not found: {p.source})')} as match, 0 as \"offset\", 0 as length from {PLANTED} where not regexp_matches(text, {re2(p)})"
        for i, p, _, name in required
    )
    replaced = "text"
    for _, p, _, _ in valid:
        replaced = f"regexp_replace({replaced}, {re2(p)}, '[REDACTED]', 'g')"
    o["regex_redact"] = f"select doc_id, {digest('t')} from (select doc_id, {replaced} as t from {PLANTED})"
    url = "'https?://[a-z!$-_]+'"
    o["urls_extract"] = f"select doc_id, unnest(range(len(u))) as ord, unnest(u) as url from (select doc_id, regexp_extract_all(text, {url}) as u from {PLANTED})"
    host = "lower(regexp_replace(regexp_replace(regexp_extract(url, '^https?:/+([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
    page = "coalesce(html, '') || coalesce('<a href=\"' || url || '\">source</a>', '')"
    page_urls = f"(select page_id, unnest(range(len(u))) as ord, unnest(u) as url from (select page_id, regexp_extract_all({page}, {url}) as u from pages))"
    o["urls_of_pages"] = f"select page_id, ord, url, {host} as host from {page_urls}"
    found = f"(select doc_id, text, unnest(range(len(u))) as idx, unnest(u) as url from (select doc_id, text, regexp_extract_all(text, {url}) as u from {PLANTED}))"
    blocked = (
        f"(select doc_id, cast(idx as int) as idx, 'high' as severity, 'suspicious_url' as pattern, url as m, strpos(text, url) - 1 as off "
        f"from (select *, {host} as host from {found}) join (values {', '.join(f'({lit(x)})' for x in BLOCKED_DOMAINS)}) as b(dom) on host = dom or ends_with(host, '.' || dom))"
    )
    o["urls_blocked"] = f"select doc_id, idx as index, severity, pattern, m as match, off as \"offset\", length(m) as length from {blocked}"
    listed = f"(select distinct {host} as domain from (select url from pages where contains(url, '.net')))"
    o["urls_blocked_by_table"] = (
        f"select page_id, ord as index, url, host, domain from (select *, {host} as host from {page_urls}) join {listed} on host = domain or ends_with(host, '.' || domain)"
    )
    code = [(0, r.pattern, r.severity, r.id) for r in DANGEROUS_CODE]
    o["code_scan"] = f"select {out} from {every(code)}"
    cut = f"select doc_id, idx, severity, pattern, {CUT} as m, off, length(m) as len from "
    everything = f"({cut}{every(banned + required + code)} union all select doc_id, idx, severity, pattern, m, off, length(m) from {blocked})"
    o["output_scan_all"] = f"select doc_id, idx as index, severity, pattern, m as match, off as \"offset\", len as length from {everything}"
    plain = f"({cut}{every(banned + code)} union all select doc_id, idx, severity, pattern, m, off, length(m) from {blocked})"
    o["output_verdicts"] = f"select doc_id, count(pattern) as alerts, count(pattern) = 0 as is_safe from documents left join {plain} using (doc_id) group by doc_id"
    return o


def _redaction_queries() -> dict[str, str]:
    o = {f"redact_{name}": redacted_digest(preset(name)) for name in ("secrets", "pii", "strict")}
    o["redact_allowlist"] = redacted_digest(compile_policy(q.ALLOW_POLICY))
    o["redact_custom_policy"] = redacted_digest(compile_policy(q.CUSTOM_POLICY))
    o["redact_context_gate"] = redacted_digest(Policy(tuple(r for r in PRESETS["strict"] if r.context)))
    strict = preset("strict")
    counted = redacted(PLANTED, "doc_id, lang", strict, counts=True)
    sums = ", ".join(f"sum(n{i}) as n{i}" for i in range(len(strict.rules)))
    rows = " union all ".join(f"select lang, {lit(r.id)} as rule, cast(n{i} as bigint) as replacements from s" for i, r in enumerate(strict.rules))
    o["redact_stats"] = f"with s as (select lang, {sums} from ({counted}) group by lang) select * from ({rows}) where replacements > 0"
    words = compile_policy(q.FOUR_LETTERS).rules
    # Covered: contents of messages in messages requests, part texts in contents requests.
    path = (
        f"{NOT_KEY} and ((regexp_matches(prev, '\"content\"' || chr(2) || ':$') and not contains(parts[1] || parts[2], 'zz')) "
        "or regexp_matches(prev, '\"text\"' || chr(2) || ':$') and contains(array_to_string(parts, ''), '\"contents\"') "
        "and not (i > 2 and contains(parts[i-2], '\"parts\"') and contains(parts[i-3], '\"systemInstruction\"')))"
    )
    o["redact_paths"] = f"select capture_id, {digest('body')} from {json_redacted(CAPTURES, 'capture_id', 'request_body', words, path)}"
    o["redact_json_bodies"] = (
        f"select capture_id, {digest('body')} from {json_redacted('(select * from ' + CAPTURES + ' where not response_is_streaming)', 'capture_id', 'response_body', words, NOT_KEY)} "
        f"union all select capture_id, {digest('response_body')} from {CAPTURES} where response_is_streaming"
    )
    o["redact_rule_list"] = f"select capture_id, {digest('body')} from {json_redacted(PLANTED_CAPTURES, 'capture_id', 'request_body', PRESETS['strict'][20:26], NOT_KEY)}"
    o["redact_then_log"] = (
        f"select capture_id, 'accept' as request_headers, 'server' as response_headers, {digest('body')} from {json_redacted(PLANTED_CAPTURES, 'capture_id', 'request_body', PRESETS['strict'], NOT_KEY)}"
    )
    path_of = "regexp_replace(regexp_replace(substr(fullkey, 2), '\\[[0-9]+\\]', '.*', 'g'), '^\\.', '')"
    o["json_leaf_paths"] = (
        f"select {path_of} as path, count(*) as leaves, cast(sum(length(json_extract_string(value, '$'))) as bigint) as chars "
        f"from (select t.fullkey, t.value, t.type from {CAPTURES} c, json_tree(c.request_body) t) where type = 'VARCHAR' group by 1"
    )
    junk = "contains(x, '{broken')"
    lines = "string_split(response_body, chr(10))"
    quoted = f"list_transform({lines}, lambda x: case when {junk} then x else replace(x, '\"text\":\"', '\"text\":\"> ') end)"
    marked = f"array_to_string(list_transform(list_append({quoted}, 'event: lines ' || len({lines})), lambda x: x || ' '), chr(10))"
    whole = "case when try_cast(response_body as json) is null then response_body else replace(response_body, 'end_turn', 'stop') end || chr(10)"
    bad = f"case when response_is_streaming then len(list_filter({lines}, lambda x: {junk})) > 0 else try_cast(response_body as json) is null end"
    o["response_chain"] = (
        f"select capture_id, case when bad then 'rename' else '' end as failed_steps, {digest('b')} from "
        f"(select capture_id, {bad} as bad, case when response_is_streaming then {marked} else {whole} end as b from {CAPTURES})"
    )
    streamed = "(select * from " + CAPTURES + " where response_is_streaming)"
    o["response_chain_stream"] = o["response_chain"].replace(CAPTURES, streamed)
    o["capture_observers"] = (
        f"select count(*) as captures, count_if(response_is_streaming) as streams, cast(sum(length(response_body)) as bigint) as chars from {CAPTURES}"
    )
    o["transform_fail_open"] = (
        f"select try_cast(body as json) is null as transform_failed, count(*) as requests, cast(sum(length(case when try_cast(body as json) is null then body else replace(body, ' ', '') end)) as bigint) as chars from {LOG} group by 1"
    )
    return o


def _reversible_queries() -> dict[str, str]:
    o = {}
    book = dictionary(ROWS)
    o["session_dictionary"] = f"select session_id, original, rule, placeholder from {book}"
    o["rehydrate"] = f"select row_id, {digest('text')} from {ROWS}"
    o["reverse_lookup"] = (
        f"select s.session_id, '[WORD_2]' as placeholder, original from (select distinct coalesce(session_id, '__default__') as session_id from {ROWS}) s "
        f"left join (select * from {book} where placeholder = '[WORD_2]') b using (session_id)"
    )
    o["dictionary_inventory"] = f"select session_id, rule, count(*) as entries, cast(sum(count(*)) over (partition by session_id) as bigint) as session_size from {book} group by session_id, rule"
    o["pseudonymise"] = pseudonymised(ROWS, book)
    nameless = "(select conv_id * 1000 + turn as row_id, '__default__' as session_id, text from conversations)"
    o["pseudonymise_stream_spread"] = pseudonymised(nameless, spread_dictionary(nameless))
    deltas = sse_delta_rows(CAPTURES)
    o["sse_content"] = f"select capture_id, cast(line_no as int) as line, {digest('delta')} from {deltas}"
    o["sse_answer"] = f"select capture_id, {digest('s')} from (select capture_id, string_agg(delta, '' order by line_no) as s from {deltas} group by capture_id)"
    turns = MESSAGES.replace("case when role = 'assistant' and conv_id % 3 <> 1 then 'tool' else role end as role", "role")
    answers = f"select capture_id, {digest('t0')} from (select conv_id * 1000 + turn as capture_id, text as t0 from {turns} where role = 'assistant' and turn % 4 <> 1)"
    o["sse_rehydrate_batch"] = answers
    o["sse_rehydrate_stream"] = answers
    words = "text"
    for rule in compile_policy(q.PSEUDONYM_POLICY).rules:
        words = f"regexp_replace({words}, {re2(rule.pattern)}, '[' || replace(upper({lit(rule.id)}), '-', '_') || ']', 'g')"
    o["pseudonymise_stream_sessions"] = (
        f"select conv_id * 1000 + turn as row_id, cast(conv_id as varchar) as session_id, length({words}) as chars from conversations"
    )
    return o
