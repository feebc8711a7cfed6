"""SQL for the operators' queries, where SQL can express them."""

from __future__ import annotations

from tessera.llm import merkle_manifest as merkle
from tessera.llm import source_mix as mixed
from tessera.llm import url_reputation as url
from tessera.llm import warc_fixity as warc

OP2 = """
with recursive v as (
    select vec_id, label, cast(embedding as double[]) as e from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links as (
    select a.vec_id as a, b.vec_id as b from v a join v b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98
),
reach(vec_id, root) as (
    select vec_id, vec_id from embeddings
    union
    select l.b, r.root from reach r join links l on l.a = r.vec_id where r.root < l.b
),
low as (select vec_id, min(root) as component_id from reach group by vec_id),
n as (select a, count(*) as n_links from links group by a)
select e.vec_id, coalesce(n.n_links, 0) as n_links, low.component_id, e.vec_id = low.component_id as kept
from embeddings e join low on low.vec_id = e.vec_id left join n on n.a = e.vec_id
"""

OP3 = """
with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words
    from documents
),
sets as (
    select doc_id, case when len(words) = 0 then cast([] as varchar[])
        when len(words) < 3 then [array_to_string(words, ' ')]
        else list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) end as s
    from w
),
sized as (select doc_id, len(s) as n from sets),
same as (select min(doc_id) as rep, s, len(s) as n from (select doc_id, list_sort(s) as s from sets) group by s),
member as (select doc_id, rep from (select doc_id, list_sort(s) as s from sets) join same using (s)),
gram as (select rep, n, unnest(s) as g from same),
links as (
    select a.rep as a, b.rep as b from gram a join gram b on a.g = b.g and a.rep < b.rep
    and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
edges as (select a, b from links union all select b, a from links),
reach(rep, root) as (
    select rep, rep from same
    union
    select e.b, r.root from reach r join edges e on e.a = r.rep where r.root < e.b
),
low as (select rep, min(root) as root from reach group by rep)
select z.doc_id, cast(z.n as bigint) as n_shingles,
    case when z.n = 0 then z.doc_id else low.root end as component_id
from sized z join member m on m.doc_id = z.doc_id join low on low.rep = m.rep
"""


def op1() -> str:
    def places(name: str, html: str, written: str, keep: str) -> str:
        return f"""
{name}_r as (
    select page_id // {warc.VOLUME_PAGES} as volume, page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) ||
        'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) ||
        'Content-Length: ' || strlen({html}) || chr(13) || chr(10) || chr(13) || chr(10) || {html} || chr(13) || chr(10) || chr(13) || chr(10) as record
    from pages where {written}
),
{name}_p as (
    select volume, page_id, strlen(record) as length, sha256(record) as digest,
        cast(coalesce(sum(strlen(record)) over (partition by volume order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
    from {name}_r
),
{name} as (select * from {name}_p where {keep}),
{name}_0 as (select volume, "offset" // {warc.RANGE_BYTES} as node, sha256(string_agg("offset" || ':' || length || ':' || digest, ',' order by "offset", length, digest)) as digest from {name} group by 1, 2)""" + "".join(
            f""",
{name}_{k} as (select volume, {'0' if k == warc.LEVELS else f'node // {warc.FAN_OUT}'} as node, sha256(string_agg(node || ':' || digest, ',' order by node)) as digest from (select volume, node as node, digest from {name}_{k - 1}) group by volume, {'2' if k < warc.LEVELS else '2'})"""
            for k in range(1, warc.LEVELS + 1)
        )

    html = "coalesce(html, '')"
    mark = "substr(md5(cast(page_id as varchar)), 1, 2)"
    sql = "with" + places("a", html, "true", "true") + "," + places("b", f"case when {mark} = '01' then replace({html}, '<', '{{') when {mark} = '02' then {html} || 'x' else {html} end", f"{mark} <> '00'", f"{mark} <> '03'")
    top = warc.LEVELS
    sql += f""",
roots as (select coalesce(a.volume, b.volume) as volume, a.digest as root_a, b.digest as root_b, a.digest is not distinct from b.digest as intact from a_{top} a full join b_{top} b on a.volume = b.volume),
w_{top} as (select volume, 0 as node from roots where not intact)"""
    for k in range(top - 1, -1, -1):
        parent = "0" if k == top - 1 else f"coalesce(a.node, b.node) // {warc.FAN_OUT}"
        sql += f""",
s_{k} as (select coalesce(a.volume, b.volume) as volume, coalesce(a.node, b.node) as node, a.digest is not distinct from b.digest as same
    from a_{k} a full join b_{k} b on a.volume = b.volume and a.node = b.node
    join w_{k + 1} w on w.volume = coalesce(a.volume, b.volume) and w.node = {parent}),
w_{k} as (select volume, node from s_{k} where not same)"""
    sql += """,
compared as (select volume, count(*) as n from (""" + " union all ".join(f"select volume from s_{k}" for k in range(top)) + """) group by volume),
held as (select volume, page_id, "offset", length, digest, 1 as side from a join w_0 w using (volume) where "offset" // RANGE = w.node
    union all select volume, page_id, "offset", length, digest, -1 from b join w_0 w using (volume) where "offset" // RANGE = w.node),
by_place as (select volume, page_id, length, digest, "offset", sum(side) as more from held group by all having sum(side) <> 0),
by_record as (select volume, page_id, length, digest, sum(more) as more, sum(greatest(more, 0)) as only_a from by_place group by all),
found as (select volume, list_sort(list(distinct page_id) filter (more <> 0)) as pages, sum(only_a - greatest(more, 0)) as n_shifted from by_record group by volume),
sizes as (select volume, count(*) as n, cast(sum(length) as bigint) as bytes from a group by volume)
select r.volume, coalesce(z.n, 0) as n_records, coalesce(z.bytes, 0) as n_bytes, root_a, root_b, intact, coalesce(c.n, 0) as n_compared, cast(0 as bigint) as n_nameless,
    cast(coalesce(f.n_shifted, 0) as bigint) as n_shifted, coalesce(f.pages, cast([] as bigint[])) as bad_pages
from roots r left join sizes z on z.volume = r.volume left join compared c on c.volume = r.volume left join found f on f.volume = r.volume"""
    return sql.replace("RANGE", str(warc.RANGE_BYTES))


def op5() -> str:
    z, low, high = url.Z, 1 / (1 + url.MOST_WEIGHT), 1 / (1 + url.LEAST_WEIGHT)

    def weight(b: str, n: str, m: str) -> str:
        b, n = f"cast({b} as double)", f"cast({n} as double)"
        full = f"sum({n} * ({n} - 1) * {m} * (1 - {m}))"
        return f"case when coalesce({full}, 0) <= 0 then {url.PRIOR_WEIGHT} else 1 / least(greatest(sum(({b} - {n} * {m}) * ({b} - {n} * {m}) - {n} * {m} * (1 - {m})) / {full}, {low!r}), {high!r}) - 1 end"

    fits = sorted(url.RULES, key=lambda r: -len(r[1] + r[2]))
    cond = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in fits]
    rule = "case " + " ".join(f"{c} then '{h}{p}'" for c, (_, h, p) in zip(cond, fits, strict=True)) + " end"
    verdict = "case " + " ".join(f"{c} then '{v}'" for c, (v, _, _) in zip(cond, fits, strict=True)) + f" when bad_low > {url.BAD_SHARE} and d_pages > 0 then 'block' else 'allow' end"
    labels = "string_split(name, '.')"
    two = f"cast(regexp_matches(name, '{url.two_labels(url.SECOND_LEVEL)}') as int)"
    address = f"regexp_matches(name, '{url.ADDRESS}')"
    return f"""
with rest as (select page_id, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end, '') as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url.UPPER}', '{url.LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
known as (select doc_id, min(quality) as quality from labels where quality is not null group by doc_id),
seen as (select host, quality from parts left join known on doc_id = try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint)),
counted as (select host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as name, count(case when quality = 0 then 1 end) as n_bad, count(quality) as n_pages from seen group by host),
hosts as (select host, case when {address} then name else array_to_string({labels}[-2 - {two}:], '.') end as domain,
    case when {address} then '' else array_to_string({labels}[-1 - {two}:], '.') end as suffix, n_bad, n_pages from counted),
top as (select (coalesce(sum(n_bad), 0) + 1) / (coalesce(sum(n_pages), 0) + 20) as m from hosts),
suffix_sums as (select suffix, sum(n_bad) as b, sum(n_pages) as n, (select m from top) as m from hosts group by suffix),
suffix_weight as (select {weight("b", "n", "m")} as w from suffix_sums),
suffixes as (select suffix, (w * m + b) / (w + n) as m from suffix_sums, suffix_weight),
domain_sums as (select h.domain, any_value(s.m) as m, sum(n_bad) as b, sum(n_pages) as n from hosts h join suffixes s on s.suffix = h.suffix group by h.domain),
domain_weight as (select {weight("b", "n", "m")} as w from domain_sums),
domains as (select domain, n as d_pages, (w * m + b) / (w + n) as m from domain_sums, domain_weight),
host_sums as (select host, n_pages, d_pages, n_bad, m from hosts h join domains d on d.domain = h.domain),
host_weight as (select {weight("n_bad", "n_pages", "m")} as w from host_sums),
beta as (select host, n_pages, d_pages, w * m + n_bad as a, w * (1 - m) + n_pages - n_bad as b from host_sums, host_weight),
judged as (select host, n_pages, d_pages, a / (a + b) as bad_share, a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bad_low from beta)
select p.page_id, p.host, p.path, {rule.replace('host', 'p.host').replace('path', 'p.path')} as rule, {verdict.replace('host', 'p.host').replace('path', 'p.path')} as verdict, round(j.bad_share, 6) as bad_share, round(j.bad_low, 6) as bad_low, j.n_pages as n_labelled
from parts p join judged j on j.host = p.host"""


def op11() -> str:
    def number(*of: str) -> str:
        return f"cast('0x' || substr(md5(concat_ws(':', '{mixed.SEED}', {', '.join(of)})), 1, 15) as bigint)"

    b, prime = mixed.BLOCK_WORDS, mixed.PRIME
    sql = f"""
with words as (
    select doc_id, source, cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '-' || coalesce(text, ''))), 1, 8)) as bigint) as spread, md5(coalesce(text, '')) as digest,
        cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size
    from documents
),
sizes as (select source, cast(sum(size) as bigint) as source_size from words group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as source_no from sizes),
weighed as (select *, [{', '.join(map(str, mixed.WEIGHTS))}][source_no % {len(mixed.WEIGHTS)} + 1] as weight, {float(mixed.MOST)} * source_size as most from ranked),
level as (
    select *, cast(({mixed.SHARE} * sum(source_size) over () - coalesce(sum(most) over (order by most / weight, source_no rows between unbounded preceding and 1 preceding), 0)) as double)
        / cast((sum(weight) over () - coalesce(sum(weight) over (order by most / weight, source_no rows between unbounded preceding and 1 preceding), 0)) as double) as level
    from weighed
),
share as (select level as share from level where most >= level * weight order by most / weight, source_no limit 1),
source as (
    select source, source_no, source_size, case when source_size = 0 then 0.0 else least(most, (select share from share) * weight) end as target, cast(ceil(source_size / {b}) as bigint) as n_blocks from level
),
ranges as (select *, cast(case when source_size = 0 then 0 else round(target * n_blocks / source_size) end as bigint) as quota from source),
-- Which shard drew a slot changes nothing here: once the draws are settled, a source's slots are those below its quota.
picks as (select source_no, i, i // n_blocks as epoch, i % n_blocks as x, n_blocks as n from (select source_no, n_blocks, unnest(range(quota)) as i from ranges)),
keys as (
    select source_no, epoch, r, {number("'k'", "'source'", "source_no", "epoch", "r")} % n_blocks as k, {number("'a'", "'source'", "source_no", "epoch", "r")} % {prime} as a, {number("'b'", "'source'", "source_no", "epoch", "r")} % {prime} as b
    from ranges, range({mixed.MOST}) e(epoch), range({mixed.ROUNDS}) t(r) where n_blocks > 0
),
p0 as (select source_no, i, epoch, n, x from picks)"""
    for r in range(mixed.ROUNDS):
        other = "(k.k + n - x) % n"
        sql += f""",
p{r + 1} as (
    select p.source_no, i, p.epoch, n, case when (greatest(x, {other}) % {prime} * a + b) % {prime} % 2 = 1 then {other} else x end as x
    from p{r} p join keys k on k.source_no = p.source_no and k.epoch = p.epoch and k.r = {r}
)"""
    sql += f""",
times as (select source_no, x as block, count(*) as times from p{mixed.ROUNDS} group by 1, 2),
placed as (
    select doc_id, size, r.*, coalesce(sum(size) over (partition by r.source_no order by spread, doc_id nulls first, size, digest rows between unbounded preceding and 1 preceding), 0) as first, row_number() over () as row
    from words w join ranges r on r.source is not distinct from w.source
),
pieces as (select *, least(first + size, (block + 1) * {b}) - greatest(first, block * {b}) as words from (select row, source_no, first, size, unnest(range(cast(first // {b} as bigint), cast((first + size - 1) // {b} + 1 as bigint))) as block from placed where size > 0)),
got as (select row, sum(words * times) as taken from pieces join times using (source_no, block) group by row)
select doc_id, size, source_size, target, cast(coalesce(taken, 0) as bigint) as taken from placed left join got using (row)"""
    return sql


def op13() -> str:
    def sealed(of: str) -> str:
        return f"case when {of} is null then '-' else strlen(cast({of} as varchar)) || ':' || {of} end"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(sealed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    # The lowest bit of crc32 of the decimal id, byte by byte and bit by bit.
    bits = "list_reduce(range(8), lambda c, _: xor(c >> 1, (c & 1) * 3988292384), {})"
    crc = "xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)), lambda acc, x: " + bits.format("xor(acc, x)") + ", cast(4294967295 as bigint)), 4294967295)"
    f, most = merkle.FAN_OUT, 26
    sql = f"""
with leaves as materialized (
    select doc_id, source, {leaf("text")} as digest, case when {crc} % 2 = 0 then {leaf("replace(text, chr(10), '')")} end as altered from documents
),
ranked as materialized (select *, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, digest) - 1 as place, count(*) over (partition by source) as width from leaves),
l0 as materialized (select tree, place, width, digest from ranked)"""

    def levels(name: str, first: int) -> str:
        return "".join(
            f""",
{name}{k} as materialized (
    select tree, place // {f} as place, (any_value(width) + {f - 1}) // {f} as width, sha256(string_agg(digest, '' order by place)) as digest
    from {name}{k - 1} where width > 1 group by tree, place // {f}
)"""
            for k in range(first, most + 1)
        )

    def proofs(name: str, start: str) -> str:
        out = f""",
{name}p{most} as materialized (select n.tree, n.place, s.subroot, s.proof from {name}{most} n join {start} s using (tree) where n.width = 1)"""
        for k in range(most - 1, -1, -1):
            out += f""",
{name}p{k} as materialized (
    select n.tree, n.place, s.subroot, s.proof from {name}{k} n join {start} s using (tree) where n.width = 1
    union all
    select n.tree, n.place, u.subroot, [{{'before': coalesce((select string_agg(x.digest, '' order by x.place) from {name}{k} x where x.tree = n.tree and x.place // {f} = n.place // {f} and x.place < n.place), ''),
        'after': coalesce((select string_agg(x.digest, '' order by x.place) from {name}{k} x where x.tree = n.tree and x.place // {f} = n.place // {f} and x.place > n.place), '')}}] || u.proof
    from {name}{k} n join {name}p{k + 1} u on u.tree = n.tree and u.place = n.place // {f} where n.width > 1
)"""
        return out

    sql += levels("l", 1)
    sql += ", subroots as materialized (" + " union all ".join(f"select tree, digest from l{k} where width = 1" for k in range(most + 1)) + ")"
    sql += ", t0 as materialized (select cast(0 as bigint) as tree, tree as place, count(*) over () as width, digest from subroots)" + levels("t", 1)
    sql += ", root as materialized (" + " union all ".join(f"select tree, digest from t{k} where width = 1" for k in range(most + 1)) + ")"
    sql += ", top as (select tree, digest as subroot, cast([] as struct(\"before\" varchar, \"after\" varchar)[]) as proof from root)" + proofs("t", "top")
    sql += ", over_tree as materialized (select p.place as tree, t0.digest as subroot, p.proof from tp0 p join t0 on t0.place = p.place)" + proofs("l", "over_tree")
    sql += f""",
made as (
    select r.doc_id, r.digest as leaf, p.subroot, (select digest from root) as root, sha256(array_to_string(list_transform(p.proof, lambda s: s.before || s.after), '')) as proof_sha256,
        list_reduce(list_transform(p.proof, lambda s: [s.before, s.after]), lambda acc, s: [sha256(s[1] || acc[1] || s[2])], [coalesce(altered, r.digest)])[1] as folded_root
    from ranked r join lp0 p on p.tree = r.tree and p.place = r.place
)
select *, folded_root = root as verified from made"""
    return sql


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_fixity": op1(), "op2_embedding_dedup": OP2, "op3_ngram_join": OP3, "op5_url_filter": op5(), "op11_source_mix": op11(), "op13_merkle_manifest": op13()}
