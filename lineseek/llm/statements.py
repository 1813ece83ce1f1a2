"""SQL twins of the queries whose rows DuckDB can express, written from their definitions."""

from __future__ import annotations

from lineseek.llm import manifest, urls

# Levels spelled out: sources of up to 3 ** SOURCE_LEVELS documents, and so many sources.
SOURCE_LEVELS, TOP_LEVELS = 13, 7
# Fixed value: the reversed polynomial of CRC-32.
CRC_POLYNOMIAL = 3988292384


def url_filter() -> str:
    order = urls.ORDER
    host = "translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
    longest = sorted(urls.RULES, key=lambda r: -len(r[1]))

    def case(value) -> str:
        out = ""
        for verdict, rule in longest:
            domain, _, rest = rule.partition("/")
            fits = f"(host = '{domain}' or ends_with(host, '.{domain}')) and starts_with(path, '/{rest}')"
            out += f" when {fits} then '{value(verdict, rule)}'"
        return f"case{out} end"

    levels, below = [], None
    for length in range(1, order + 2):
        name = f"p{length}"
        gram = "gram" if length > order else f"right(gram, {2 * length})"
        prior = lambda side: "1.0::double / 256" if below is None else f"b.p_{side}"
        join = "" if below is None else f"join {below} b on right(c.gram, {2 * length - 2}) = b.gram"

        def p(side: str) -> str:
            n, over = f"c.n_{side}", f"over (partition by left(c.gram, {2 * length - 2}))"
            total, kinds = f"sum({n}) {over}", f"sum(({n} > 0)::int) {over}"
            return f"case when {total} > 0 then ({n} + {kinds} * {prior(side)}) / ({total} + {kinds}) else {prior(side)} end as p_{side}"

        levels.append(f"""{name} as (
        select c.gram, {p("allow")}, {p("block")}
        from (select {gram} as gram, sum(n_allow) as n_allow, sum(n_block) as n_block from counted group by all) c {join})""")
        below = name
    kept = ", ".join(f"'{c}'" for c in urls.CALIBRATION)
    return f"""
    with cut as (select page_id, coalesce(url, '') as u, {host} as host, {path} as path from pages),
    ruled as (select *, {case(lambda v, r: r)} as rule, {case(lambda v, r: v)} as decided from cut),
    distinct_urls as (
        select u, any_value(decided) as decided, any_value(decided) is not null and left(md5(u), 1) not in ({kept}) as trains
        from ruled group by u),
    grams as (
        select u, decided, trains, substring(h, 2 * i + 1, {2 * order + 2}) as gram
        from (select *, '{"00" * order}' || hex(encode(u)) || '00' as h, unnest(range(0, strlen(u) + 1)) as i from distinct_urls)),
    counted as (
        select gram, count(*) filter (where trains and decided = 'allow') as n_allow,
               count(*) filter (where trains and decided = 'block') as n_block
        from grams group by gram),
    {", ".join(levels)},
    scored as (
        select u, any_value(decided) as decided, any_value(trains) as trains,
               sum(floor((ln(p_allow) - ln(p_block)) * {urls.SCALE} + 0.5)::bigint)::bigint as total, count(*) as n
        from grams join {below} using (gram) group by u),
    binned as (
        select *, greatest(-{urls.MOST_BIN}, least({urls.MOST_BIN}, floor(total / (n * {urls.SCALE // urls.PER_NAT})::double))) as bin from scored),
    held as (
        select bin, count(*) filter (where decided = 'allow') as a, count(*) filter (where decided = 'block') as b
        from binned where decided is not null and not trains group by bin),
    costs as (
        select bin, sum(a) over w - a as below, sum(b) over () - (sum(b) over w - b) as above, sum(a) over () as a_all, sum(b) over () as b_all
        from held window w as (order by bin)),
    ends as (
        select * from costs
        union all select max(bin) + 1, any_value(a_all), 0, any_value(a_all), any_value(b_all) from costs),
    chosen as (select coalesce(min_by(bin, (below * b_all + above * a_all, bin)) filter (where a_all > 0 and b_all > 0), -1e9) as least from ends)
    select page_id, host, path, rule, coalesce(r.decided, case when bin >= least then 'allow' else 'block' end) as verdict,
           total / (n * {urls.SCALE})::double as score
    from ruled r join binned using (u) cross join chosen"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(text if name == 'text' else name) for name in manifest.FIELDS)})"


def _crc(text: str) -> str:
    """Unsigned CRC-32 of ASCII text: its characters, each followed by eight shifts (-1)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = f"xor(a >> 1, {CRC_POLYNOMIAL} * (a & 1))"
    return f"xor(list_reduce({steps}, lambda a, x: case when x >= 0 then xor(a, x) else {shift} end, 4294967295), 4294967295)"


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs name_0.. name_levels (g, r, d); a group that has one node left keeps it."""
    parts = [f"{name}_0 as ({leaves})"]
    for k in range(1, levels + 1):
        parts.append(f"""{name}_{k} as (
        select g, r // {manifest.FAN} as r, case when any_value(c) = 1 then any_value(d) else sha256(string_agg(d, '' order by r)) end as d
        from (select *, count(*) over (partition by g) as c from {name}_{k - 1}) group by g, r // {manifest.FAN})""")
    return ", ".join(parts)


def _steps(name: str, levels: int) -> str:
    """CTEs name_s0.. (g, r, b, a): the digests before and after a node in its run."""
    parts = []
    for k in range(levels):
        run = f"over (partition by g, r // {manifest.FAN} order by r rows between"
        parts.append(f"""{name}_s{k} as (
        select g, r, coalesce(string_agg(d, '') {run} unbounded preceding and 1 preceding), '') as b,
               coalesce(string_agg(d, '') {run} 1 following and unbounded following), '') as a
        from {name}_{k})""")
    return ", ".join(parts)


def merkle_manifest() -> str:
    fan = manifest.FAN
    steps = [("x", "g", "r", k) for k in range(SOURCE_LEVELS)] + [("t", "0", "g", k) for k in range(TOP_LEVELS)]
    joins, proof, fold = "", [], "coalesce(other, leaf)"
    for tree, group, rank, k in steps:
        alias = f"{tree}{k}"
        joins += f" join {tree}_s{k} {alias} on {alias}.g = l.{group}" if group != "0" else f" join {tree}_s{k} {alias} on {alias}.g = 0"
        joins += f" and {alias}.r = l.{rank} // {fan**k}"
        proof.append(f"{alias}.b || {alias}.a")
    folded, previous = [], "l"
    for number, (tree, _, _, k) in enumerate(steps):
        alias = f"{tree}{k}"
        fold = f"case when {alias}_b = '' and {alias}_a = '' and {alias}_c = 1 then f else sha256({alias}_b || f || {alias}_a) end"
        folded.append(f"f{number + 1} as (select * exclude (f), {fold} as f from f{number})")
        previous = f"f{number + 1}"
    columns = ", ".join(f"{t}{k}.b as {t}{k}_b, {t}{k}.a as {t}{k}_a, {t}{k}.c as {t}{k}_c" for t, _, _, k in steps)
    counted = lambda name, levels: ", ".join(
        f"{name}_c{k} as (select g, count(*) as c from {name}_{k} group by g)" for k in range(levels)
    )
    for tree, levels in (("x", SOURCE_LEVELS), ("t", TOP_LEVELS)):
        for k in range(levels):
            joins = joins.replace(f" join {tree}_s{k} ", f" join (select s.*, c from {tree}_s{k} s join {tree}_c{k} using (g)) ")
    cut = "replace(text, chr(10), '')"
    return f"""
    with leaves as (
        select doc_id, source, {_leaf("text")} as leaf,
               case when {_crc("doc_id::varchar")} % 2 = 0 then {_leaf(cut)} end as other
        from documents),
    sources as (
        select source, row_number() over (order by source is not null, encode(source)) - 1 as g from (select distinct source from documents)),
    placed as (
        select doc_id, leaf, other, g, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as r
        from leaves join sources on leaves.source is not distinct from sources.source),
    {_tree("x", "select g, r, leaf as d from placed", SOURCE_LEVELS)},
    {_tree("t", f"select 0 as g, g as r, d from x_{SOURCE_LEVELS}", TOP_LEVELS)},
    {_steps("x", SOURCE_LEVELS)}, {_steps("t", TOP_LEVELS)},
    {counted("x", SOURCE_LEVELS)}, {counted("t", TOP_LEVELS)},
    f0 as (
        select l.doc_id, l.leaf, s.d as subroot, top.d as root, sha256({" || ".join(proof)}) as proof_sha256,
               coalesce(other, leaf) as f, {columns}
        from placed l join x_{SOURCE_LEVELS} s on s.g = l.g cross join t_{TOP_LEVELS} top {joins}),
    {", ".join(folded)}
    select doc_id, leaf, subroot, root, proof_sha256, f as folded_root, f = root as verified from {previous}"""


def statements() -> dict[str, str]:
    return {"op11_url_filter": url_filter(), "op12_manifest": merkle_manifest()}
