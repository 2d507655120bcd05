"""DuckDB SQL for every registered query, written independently of the Spark code.

Each statement inlines the adapter views (FIXTURES.md) and the steps it needs as CTEs.
"""

from __future__ import annotations

import re

NOW = "timestamp '2024-06-01 00:00:00'"


def _region(expr: str) -> str:
    return f"case {expr} when 0 then 'DE' when 1 then 'ES' when 2 then 'IT' else 'UK' end"


def _asin(expr: str) -> str:
    return f"'B' || lpad(cast({expr} as varchar), 9, '0')"


def _blank(c: str) -> str:
    return f"trim(coalesce({c}, '')) = ''"


VALUES = [
    "im_sku", "sales_channel", "level_1", "parent_sku", "linworks_title", "modified_by",
    "comment", "date", "amazon_title",
]
OVERRIDDEN = [
    "im_sku", "sales_channel", "level_1", "linworks_title", "parent_sku", "modified_by",
    "comment",
]
TRIMMED = {"im_sku", "level_1", "linworks_title", "parent_sku"}
CATALOGUE = [
    "id", "date", "marketplace_sku", "asin", "im_sku", "region", "sales_channel", "level_1",
    "linworks_title", "amazon_title", "parent_sku", "modified_by", "modified_by_finance",
    "modified_by_admin", "comment", "comment_by_finance", "created_at", "updated_at",
]
STAGING = [
    "id", "marketplace_sku", "asin", "im_sku", "parent_sku", "region", "marketplace",
    "level_1", "level_2", "level_3", "level_4", "level_5", "linworks_title",
    "marketplace_sales_table", "channel", "company", "modified_by", "modified_by_finance",
    "modified_by_admin", "comment", "comment_by_finance", "created_at", "updated_at",
]
HIERARCHY = [
    "marketplace_sku", "asin", "im_sku", "parent_sku", "region", "marketplace", "level_1",
    "level_2", "level_3", "level_4", "level_5", "company", "marketplace_sales_table",
    "channel", "linworks_title",
]
ATTR = ["modified_by", "modified_by_finance", "modified_by_admin"]
KEY3 = "marketplace_sku, asin, region"
SEQ = "marketplace_sku, asin, region, feed_channel"


def _override(rows: str, sku: str) -> str:
    cols = []
    for c in VALUES:
        if c in OVERRIDDEN:
            new = f"trim(m.{c})" if c in TRIMMED else f"m.{c}"
            cols.append(f"case when m.id is not null then {new} else r.{c} end as {c}")
        else:
            cols.append(f"r.{c}")
    return f"""select r.marketplace_sku, r.asin, r.region, {', '.join(cols)}, r.feed_channel
        from {rows} r left join by_sku_region m
          on m.marketplace_sku = {sku} and m.region = r.region"""


_ALT = """case when r.marketplace_sku like 'M-%' then substr(r.marketplace_sku, 3)
               else 'M-' || r.marketplace_sku end"""

_STRING = "cast(null as varchar)"

_DEPT = f"""case when not ({_blank('modified_by')}) then 'modified_by'
    when not ({_blank('modified_by_finance')}) then 'modified_by_finance'
    when not ({_blank('modified_by_admin')}) then 'modified_by_admin' end"""


def _spread_columns(value: str | None, named: bool) -> str:
    out = []
    for c in CATALOGUE:
        if c == value:
            out.append(f"case when k.key is not null then k.value else t.{c} end as {c}")
        elif named and c in ATTR:
            out.append(f"coalesce(k.{c}, t.{c}) as {c}")
        else:
            out.append(f"t.{c}")
    return ", ".join(out)


def _keyed(key: str, value: str) -> str:
    names = ", ".join(
        f"arg_max({c}, edit_seq) filter (where dept = '{c}') as {c}" for c in ATTR
    )
    return f"""select {key} as key, last(value_ order by edit_seq) as value, {names}
        from (select *, {value} as value_, {_DEPT} as dept from valid)
        where {key} is not null and {key} <> '' group by 1"""


CTES = {
    "feed": f"""select '  ' || case when l_suppkey % 4 = 0 then 'm-' else '' end || 'sku' || (l_partkey // 5) || ' ' as seller_sku,
        {_asin('l_partkey // 13')} as asin, {_region('l_suppkey % 5')} as region,
        case l_returnflag when 'N' then 'Non-Amazon'
          when 'A' then ' Amazon.' || case l_suppkey % 5 when 0 then 'de' when 1 then 'es' when 2 then 'it' else 'co.uk' end
          else case when l_linenumber % 2 = 0 then 'amazon.de' end end as sales_channel,
        l_shipdate as purchase_date, 'Item ' || l_partkey || ' of ' || l_suppkey as title,
        case when l_linestatus = 'F' then 'Shipped' else 'Pending' end as order_status
        from lineitem""",
    "catalogue": f"""select p_partkey as id,
        case when p_partkey % 2 = 0 then '2023-01-01 00:00:00' end as date,
        case when p_partkey % 3 = 0 then 'M-' else '' end || 'SKU' || (p_partkey // 5) as marketplace_sku,
        {_asin('p_partkey // 13')} as asin,
        case when p_partkey % 5 = 0 then null when p_partkey % 31 = 0 then ''
          else 'IM' || case when (p_partkey // 13) % 3 < 2 then p_partkey // 26 else 1000000 + p_partkey // 6 end
               || case when p_partkey % 7 = 0 then '+' else '' end end as im_sku,
        {_region('p_size % 4')} as region,
        case p_size % 3 when 0 then 'AMAZON.DE' when 1 then 'Amazon.co.uk' else 'Amazon.it' end as sales_channel,
        case when p_partkey % 3 = 0 then null when p_partkey % 13 = 0 then '  ' else p_type end as level_1,
        case when p_partkey % 4 <> 1 then ' ' || p_name end as linworks_title,
        case when p_partkey % 3 = 0 then 'old ' || p_name end as amazon_title,
        case when p_partkey % 6 >= 3 then ' P' || (p_partkey % 25) || ' ' end as parent_sku,
        case when p_partkey % 2 = 1 then 'scm' || (p_partkey % 3) end as modified_by,
        case when p_partkey % 7 = 1 then 'fin' end as modified_by_finance,
        {_STRING} as modified_by_admin,
        case when p_partkey % 4 = 0 then 'note ' || p_partkey end as comment,
        {_STRING} as comment_by_finance,
        timestamp '2024-01-01' + to_days(cast(p_partkey % 400 as integer)) as created_at,
        timestamp '2024-01-01' + to_days(cast(p_partkey % 400 as integer)) as updated_at
        from part""",
    "staging": f"""select o_orderkey as id,
        case when o_orderkey % 97 = 0 then ' ' else 'SKU' || (o_orderkey // 10) end as marketplace_sku,
        case when o_orderkey % 89 = 0 then '' else {_asin('o_orderkey // 20')} end as asin,
        case when o_custkey % 3 > 0 then 'IM' || (o_orderkey // 40) end as im_sku,
        case when o_orderkey % 8 = 2 then null when o_orderkey % 16 = 5 then ' ' else 'P' || (o_orderkey % 25) end as parent_sku,
        {_region('o_custkey % 4')} as region, 'Amazon.uk' as marketplace,
        case when o_custkey % 2 = 0 then o_orderpriority end as level_1,
        case when o_custkey % 5 = 0 then o_orderstatus end as level_2,
        {_STRING} as level_3, {_STRING} as level_4, {_STRING} as level_5,
        case when o_orderkey % 7 <> 0 then 'T' || o_orderkey end as linworks_title,
        'stg_tr_amazon_raw' as marketplace_sales_table, 'Amazon' as channel, 'B2fitness' as company,
        case when o_orderkey % 4 = 0 then 'scm' || (o_orderkey % 3) end as modified_by,
        {_STRING} as modified_by_finance, {_STRING} as modified_by_admin, {_STRING} as comment,
        {_STRING} as comment_by_finance, o_orderdate as created_at, o_orderdate as updated_at
        from orders""",
    "staged_before": f"""select s_suppkey * 3 as id,
        'SKU' || (s_suppkey * 3 + case when s_suppkey % 5 = 0 then 1 else 0 end) as marketplace_sku,
        {_asin('s_suppkey // 4')} as asin, {_STRING} as im_sku, {_STRING} as parent_sku,
        {_region('s_nationkey % 4')} as region, 'Amazon.it' as marketplace, {_STRING} as level_1,
        'L2' as level_2, {_STRING} as level_3, {_STRING} as level_4, {_STRING} as level_5,
        {_STRING} as linworks_title, 'stg_tr_amazon_raw' as marketplace_sales_table,
        'Amazon' as channel, 'B2fitness' as company, {_STRING} as modified_by,
        {_STRING} as modified_by_finance, {_STRING} as modified_by_admin, s_name as comment,
        {_STRING} as comment_by_finance, timestamp '2024-01-01' as created_at,
        timestamp '2024-01-01' as updated_at from supplier""",
    "hierarchy": f"""select 'SKU' || p_partkey as marketplace_sku, {_asin('p_partkey // 13')} as asin,
        'IM' || (p_partkey // 5) as im_sku, 'H' || (p_partkey % 5) as parent_sku,
        {_region('p_size % 4')} as region, 'Amazon.uk' as marketplace, p_type as level_1,
        p_brand as level_2, {_STRING} as level_3, {_STRING} as level_4, {_STRING} as level_5,
        'B2fitness' as company, 'stg_tr_amazon_raw' as marketplace_sales_table,
        'Amazon' as channel, p_name as linworks_title from part""",
    "edits": f"""select event_id as edit_seq, event_id // 4 as id,
        'SKU' || (event_id // 4 + case when event_id % 40 = 7 then 1 else 0 end) as marketplace_sku,
        case when event_id % 101 = 0 then null
          else {_asin('event_id // 52 + case when event_id % 3 = 0 then 1 else 0 end')} end as asin,
        case when user_id % 10 = 9 then 'FR' else {_region('user_id % 4')} end as region,
        case when event_id % 400 = 0 then '' else ' im' || (event_id // 104) || ' ' end as im_sku,
        case event_id % 6 when 0 then null when 1 then '  ' when 2 then '' else ' E' || (event_id % 7) end as parent_sku,
        case user_id % 4 when 0 then 'Amazon.de' when 1 then 'Amazon.es' when 2 then 'Amazon.it' else 'Amazon.co.uk' end as sales_channel,
        case when event_id % 2 = 1 then 'L' || (user_id % 10) end as level_1,
        case when event_id % 5 >= 3 then 'edited ' || event_id end as linworks_title,
        case when event_id % 9 = 0 then props end as comment, {_STRING} as comment_by_finance,
        case when event_type = 'click' then 'scm' || user_id else ' ' end as modified_by,
        case when event_type = 'purchase' then 'fin' || user_id end as modified_by_finance,
        case when event_type in ('error', 'click') then 'adm' || user_id end as modified_by_admin
        from events""",
    # Feed query.
    "projected": """select upper(trim(seller_sku)) as seller_sku, asin, region,
        upper(trim(sales_channel)) as sales_channel, purchase_date, title, order_status from feed""",
    "clean": """select seller_sku, asin, region, sales_channel, purchase_date, title from projected
        where order_status = 'Shipped' and sales_channel <> 'NON-AMAZON'""",
    "newest": """select seller_sku, sales_channel, purchase_date, title from clean
        qualify row_number() over (partition by seller_sku, sales_channel
          order by purchase_date desc nulls last, title desc nulls last) = 1""",
    "sellers": """select d.seller_sku, d.asin, d.region, d.sales_channel, n.purchase_date as date, n.title
        from (select distinct seller_sku, asin, region, sales_channel from clean) d
        left join newest n on n.seller_sku = d.seller_sku and n.sales_channel = d.sales_channel""",
    # Mapping.
    "mapped_catalogue": f"""select id, {KEY3}, {', '.join(VALUES)} from catalogue
        where im_sku is not null and im_sku <> ''""",
    "by_full_key": f"""select * from mapped_catalogue
        qualify row_number() over (partition by {KEY3} order by id desc) = 1""",
    "by_sku_region": """select * from mapped_catalogue
        qualify row_number() over (partition by marketplace_sku, region order by id desc) = 1""",
    "mapped": """select s.seller_sku as marketplace_sku, s.asin, s.region, m.im_sku,
        case when m.id is not null then m.sales_channel else s.sales_channel end as sales_channel,
        m.level_1, m.parent_sku, m.linworks_title, m.modified_by, m.comment,
        case when m.id is not null then m.date else strftime(s.date, '%Y-%m-%d %H:%M:%S') end as date,
        case when m.id is not null then m.amazon_title else s.title end as amazon_title,
        s.sales_channel as feed_channel
        from sellers s left join by_full_key m
          on m.marketplace_sku = s.seller_sku and m.asin = s.asin and m.region = s.region""",
    "harmonised": """select * replace (
          case when filled > 0 and bases = 1 and (im_sku is null or im_sku in ('', base))
               then case when plus then base || '+' else base end else im_sku end as im_sku)
        from (select r.*,
            (select count(distinct regexp_replace(q.im_sku, '[+]$', '')) from mapped q where q.asin = r.asin) as bases,
            (select max(regexp_replace(q.im_sku, '[+]$', '')) from mapped q where q.asin = r.asin) as base,
            (select count(*) from mapped q where q.asin = r.asin and q.im_sku <> '') as filled,
            (select bool_or(q.im_sku like '%+') from mapped q where q.asin = r.asin) as plus
          from mapped r)""",
    "first_complete": f"""select trim(im_sku) as im_sku, level_1, linworks_title from harmonised
        where not ({_blank('im_sku')}) and not ({_blank('level_1')}) and not ({_blank('linworks_title')})
        qualify row_number() over (partition by trim(im_sku) order by {SEQ}) = 1""",
    "enriched": f"""select h.* exclude (bases, base, filled, plus) replace (trim(h.im_sku) as im_sku,
          case when {_blank('h.level_1')} then coalesce(f.level_1, h.level_1) else h.level_1 end as level_1,
          case when {_blank('h.linworks_title')} then coalesce(f.linworks_title, h.linworks_title)
               else h.linworks_title end as linworks_title)
        from harmonised h left join first_complete f on f.im_sku = trim(h.im_sku)""",
    "parents": f"""select * replace (case when im_sku is null then trim(parent_sku) else coalesce(
          last_value(trim(parent_sku) ignore nulls) over (partition by im_sku order by {SEQ}
            rows between unbounded preceding and current row),
          first_value(trim(parent_sku) ignore nulls) over (partition by im_sku order by {SEQ}
            rows between current row and unbounded following)) end as parent_sku) from enriched""",
    "exact": _override("parents", "r.marketplace_sku"),
    "final": _override("exact", _ALT),
    # Merge.
    "candidates": f"""select f.*, c.id, c.level_1 as before from (select * from final
          qualify row_number() over (partition by {KEY3} order by {SEQ.replace(',', ' desc,')} desc) = 1) f
        left join (select * from catalogue qualify row_number() over (partition by {KEY3} order by id desc) = 1) c
          using ({KEY3})""",
    "merged": f"""select {', '.join(
            f'case when u.id is not null then u.{c} else c.{c} end as {c}' if c in VALUES else f'c.{c}'
            for c in CATALOGUE)}
        from catalogue c left join candidates u on u.id = c.id
        union all by name
        select (select max(id) from catalogue) + row_number() over (order by {KEY3}) as id,
          {KEY3}, {', '.join(VALUES)}, {NOW} as created_at, {NOW} as updated_at
        from candidates where id is null""",
    "stamped": """select c.* replace (
          case when n.seller_sku is not null then strftime(n.purchase_date, '%Y-%m-%d %H:%M:%S') else c.date end as date,
          case when n.seller_sku is not null then n.title else c.amazon_title end as amazon_title)
        from catalogue c left join newest n
          on lower(n.seller_sku) = lower(c.marketplace_sku) and lower(n.sales_channel) = lower(c.sales_channel)""",
    # Publish.
    "last_staged": f"""select marketplace_sku, region, {', '.join(
            f'arg_max({c}, id) filter (where {c} is not null) as {c}'
            for c in STAGING if c not in ('marketplace_sku', 'region'))}, count(*) as n_rows
        from staging where marketplace_sku is not null and region is not null
        group by marketplace_sku, region""",
    "actions": f"""select *, case
          when {_blank('marketplace_sku')} or {_blank('region')} or {_blank('asin')} then 'skip'
          when {_blank('im_sku')} then 'unmap' else 'upsert' end as action from last_staged""",
    "narrow_actions": """select * replace (case when action = 'upsert' and length(parent_sku) > 2 then 'fail'
          else action end as action) from actions""",
    "upserts": f"""select * replace (coalesce(
          last_value(case when not ({_blank('parent_sku')}) then parent_sku end ignore nulls)
            over (partition by im_sku order by marketplace_sku, region
              rows between 1 following and unbounded following), parent_sku) as parent_sku)
        from actions where action = 'upsert'""",
    "last_parent": f"""select im_sku, parent_sku from actions
        where action = 'upsert' and not ({_blank('parent_sku')})
        qualify row_number() over (partition by im_sku order by marketplace_sku desc, region desc) = 1""",
    "reparented": """select h.* replace (coalesce(p.parent_sku, h.parent_sku) as parent_sku)
        from hierarchy h left join last_parent p on p.im_sku = h.im_sku""",
    # Edits.
    "checked_once": """select *, case when id is null then 'missing_id'
          when marketplace_sku is null then 'missing_marketplace_sku' when asin is null then 'missing_asin'
          when region is null then 'missing_region' when sales_channel is null then 'missing_sales_channel'
          when region not in ('IT', 'UK', 'DE', 'ES') then 'no_company' end as reason from edits e""",
    # One SKU after another is taken by an id or refused, in a single fold over the edits.
    "claims": """select id, marketplace_sku as sku from checked_once where reason is null
        union select id, marketplace_sku from staged_before""",
    "disputed": """select distinct id from claims where sku in (
        select sku from claims group by sku having count(distinct id) > 1)""",
    "folded": """select list_reduce(
          (select list({'id': id, 'sku': marketplace_sku, 'seq': edit_seq,
              'held': []::struct(id bigint, sku varchar)[], 'refused': []::bigint[]} order by edit_seq)
            from checked_once where reason is null and id in (select id from disputed)),
          lambda a, e: case
            when len(list_filter(a.held, lambda h: h.sku = e.sku and h.id <> e.id)) > 0 then
              {'id': a.id, 'sku': a.sku, 'seq': a.seq, 'held': a.held, 'refused': list_append(a.refused, e.seq)}
            else {'id': a.id, 'sku': a.sku, 'seq': a.seq, 'refused': a.refused, 'held': list_append(
              list_filter(a.held, lambda h: h.id <> e.id), {'id': e.id, 'sku': e.sku})} end,
          {'id': 0::bigint, 'sku': '', 'seq': 0::bigint, 'held': (select coalesce(list({'id': id, 'sku': marketplace_sku}), [])
            from staged_before where id in (select id from disputed)), 'refused': []::bigint[]}).refused as refused""",
    "checked": """select * replace (case when reason is not null then reason
          when edit_seq in (select unnest(refused) from folded) then 'duplicate_sku' end as reason) from checked_once""",
    "valid": "select * exclude (reason) from checked where reason is null",
    "objects": f"""select l.id, l.edit_seq, c.date, l.marketplace_sku, l.asin, l.im_sku, l.region, l.sales_channel,
        l.level_1, l.linworks_title, c.amazon_title,
        case when l.parent_sku <> '' then trim(l.parent_sku) end as parent_sku,
        {', '.join(f'coalesce(a.{c}, c.{c}) as {c}' for c in ATTR)},
        l.comment, l.comment_by_finance, coalesce(c.created_at, {NOW}) as created_at, {NOW} as updated_at,
        c.id is null as created
        from (select * from valid qualify row_number() over (partition by id order by edit_seq desc) = 1) l
        join (select id, {', '.join(
            f'arg_max({c}, edit_seq) filter (where not ({_blank(c)})) as {c}' for c in ATTR)}
          from valid group by id) a using (id)
        left join catalogue c on c.id = l.id""",
    "set_rows": f"""select {', '.join(CATALOGUE)} from catalogue where id not in (select id from objects)
        union all select {', '.join(CATALOGUE)} from objects""",
    # Edits one after another: rows, the ASINs they have and the internal SKUs these bring.
    "steps": f"""select *, coalesce(lead(pos) over (partition by asin order by pos), 1000000000) as asin_next,
          coalesce(lead(pos) over (partition by id order by pos), 1000000000) as own_next,
          coalesce(lag(asin) over (partition by id order by pos),
            (select asin from catalogue c where c.id = v.id)) as was
        from (select *, row_number() over (order by edit_seq) as pos, lower(im_sku) as low,
            nullif(lower(trim(im_sku)), '') as key, case when parent_sku <> '' then trim(parent_sku) end as parent,
            case when not ({_blank('modified_by')}) then 'modified_by'
              when not ({_blank('modified_by_finance')}) then 'modified_by_finance'
              when not ({_blank('modified_by_admin')}) then 'modified_by_admin' end as dept,
            coalesce({', '.join(f"case when not ({_blank(c)}) then {c} end" for c in ATTR)}) as name
          from valid) v""",
    "memberships": """select id, asin, pos as lo, own_next as hi, pos as source from steps
        union all select c.id, c.asin, 0, coalesce((select min(pos) from steps s where s.id = c.id), 1000000000), 0
          from catalogue c""",
    "lives": """select m.id, m.source, s.low, s.pos as lo, least(s.asin_next, m.hi) as hi
        from memberships m join steps s on s.asin = m.asin and s.pos >= greatest(m.lo, 1) and s.pos < m.hi
        union all select m.id, 0, lower(c.im_sku), 0, least(m.hi, coalesce(
            (select min(pos) from steps s where s.asin = m.asin), 1000000000))
          from memberships m join catalogue c on c.id = m.id where m.source = 0""",
    "by_im": """select l.id, g.pos, g.parent, g.dept, g.name from lives l
        join steps g on g.key = l.low and g.pos > l.lo and g.pos <= l.hi and g.id <> l.id""",
    "by_asin": """select m.id, g.pos, g.im_sku, g.dept, g.name from memberships m
        join steps g on g.asin = m.asin and g.pos > m.lo and g.pos < m.hi and g.id <> m.id""",
    "named": f"""select id, pos, dept, name from by_im where dept is not null
        union all select id, pos, dept, name from by_asin where dept is not null
        union all {' union all '.join(
            f"select id, pos, '{c}', {c} from steps where not ({_blank(c)})" for c in ATTR)}""",
    "edges": f"""select e.pos, l.id as other, l.source from steps e
        join lives l on l.low = e.key and e.pos > l.lo and e.pos <= l.hi and l.id <> e.id
        where {_blank('e.level_1')} or {_blank('e.linworks_title')}""",
    "stored_complete": f"""select id from catalogue where not ({_blank('level_1')}) and not ({_blank('linworks_title')})""",
    "complete": f"""select pos from steps where not ({_blank('level_1')}) and not ({_blank('linworks_title')})
        union select pos from edges where source = 0 and other in (select id from stored_complete)
        union select e.pos from edges e join complete c on c.pos = e.source""",
    "refs": """select e.pos, arg_min(e.source, e.other) as source, min(e.other) as other from edges e
        where (e.source = 0 and e.other in (select id from stored_complete))
          or (e.source > 0 and e.source in (select pos from complete)) group by e.pos""",
    "chain": f"""select s.pos, c.c, s.pos as at from steps s, (values ('level_1'), ('linworks_title')) c(c)
        union select n.pos, n.c, r.source from chain n join steps s on s.pos = n.at join refs r on r.pos = n.at
          where r.source > 0 and case n.c when 'level_1' then {_blank('s.level_1')} else {_blank('s.linworks_title')} end""",
    "found": f"""select n.pos, {', '.join(f"""max(case when n.c = '{c}' then
            case when not ({_blank(f's.{c}')}) or r.other is null then s.{c} else k.{c} end end) as {c}"""
            for c in ('level_1', 'linworks_title'))}
        from chain n join steps s on s.pos = n.at left join refs r on r.pos = n.at
        left join catalogue k on k.id = r.other
        where not exists (select 1 from chain m where m.pos = n.pos and m.c = n.c and m.at < n.at) group by n.pos""",
    "filled": f"""select o.id, o.edit_seq, o.pos, c.date, o.marketplace_sku, o.asin, o.im_sku, o.region, o.sales_channel,
        f.level_1, f.linworks_title, c.amazon_title, o.parent as parent_sku,
        {', '.join(f"""coalesce((select arg_max(n.name, n.pos) from named n
            where n.id = o.id and n.dept = '{c}' and n.pos <= o.pos), c.{c}) as {c}""" for c in ATTR)},
        o.comment, o.comment_by_finance, coalesce(c.created_at, {NOW}) as created_at, {NOW} as updated_at,
        c.id is null as created
        from steps o join found f on f.pos = o.pos left join catalogue c on c.id = o.id where o.own_next = 1000000000""",
    "messages": """select edit_seq, id, asin, n as updated_count,
        n || ' (' || trim(coalesce(im_sku, '')) || case when n > 1
          then ') skus have been updated for ASIN (' || asin || '). Refresh your screen to see the changes.'
          else ') sku has been updated for ASIN (' || asin || ').' end as message
        from (select e.*, (select count(*) from memberships m
            where m.asin = e.asin and m.lo <= e.pos and e.pos < m.hi) as n from steps e)""",
    "filled_rows": f"""select {', '.join(CATALOGUE)} from catalogue where id not in (select id from filled)
        union all select {', '.join(CATALOGUE)} from filled""",
    "edited": f"""select t.* replace (
          case when i.at is not null then i.im_sku else t.im_sku end as im_sku,
          case when p.at is not null then p.parent else t.parent_sku end as parent_sku,
          {', '.join(f"""coalesce((select arg_max(n.name, n.pos) from named n
            where n.id = t.id and n.dept = '{c}'), t.{c}) as {c}""" for c in ATTR)})
        from filled_rows t
        left join (select id, max(pos) as at, arg_max(struct_pack(v := im_sku), pos).v as im_sku from by_asin b
          where pos > coalesce((select max(pos) from steps s where s.id = b.id), 0) group by id) i on i.id = t.id
        left join (select id, max(pos) as at, arg_max(struct_pack(v := parent), pos).v as parent from by_im b
          where pos > coalesce((select max(pos) from steps s where s.id = b.id), 0) group by id) p on p.id = t.id""",
    "keyed_im": _keyed("lower(trim(im_sku))", "case when parent_sku <> '' then trim(parent_sku) end"),
    "keyed_im_exact": _keyed("trim(im_sku)", "case when parent_sku <> '' then trim(parent_sku) end"),
    "keyed_asin": _keyed("asin", "im_sku"),
    "restaged": f"""select {', '.join(STAGING)} from staged_before where id not in (select id from filled)
        union all by name
        select o.id, o.marketplace_sku, o.asin, o.im_sku, o.parent_sku, o.region,
          case when o.sales_channel = 'Amazon.co.uk' then 'Amazon.uk' else o.sales_channel end as marketplace,
          o.level_1, s.level_2, s.level_3, s.level_4, s.level_5, o.linworks_title,
          'stg_tr_amazon_raw' as marketplace_sales_table, 'Amazon' as channel,
          case when o.region = 'ES' then 'B2fitness LTD' else 'B2fitness' end as company,
          o.modified_by, o.modified_by_finance, o.modified_by_admin, s.comment, s.comment_by_finance,
          coalesce(s.created_at, {NOW}) as created_at, {NOW} as updated_at
        from filled o left join staged_before s on s.id = o.id""",
}


def _search(table: str, columns: str, searched: list[str], words: list[str]) -> str:
    return f"select {columns} from {table} where " + " and ".join(
        "(" + " or ".join(f"coalesce(contains(lower({c}), '{w}'), false)" for c in searched) + ")"
        for w in words
    )


def _sql(body: str) -> str:
    """Prefix ``body`` with the CTEs it reaches, in their order above."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{n} as ({CTES[n]})" for n in CTES if n in needed]
    return f"with recursive {', '.join(parts)} {body}" if parts else body


_RECORD = f"{KEY3}, {', '.join(VALUES)}"
_C = ", ".join(CATALOGUE)
_H = ", ".join(HIERARCHY)
_CSV = "marketplace_sku, asin, im_sku, region, sales_channel, level_1, linworks_title, modified_by, comment"
_CSV_VALUES = """marketplace_sku, asin, nullif(im_sku, '') as im_sku, region, sales_channel, level_1,
    linworks_title, modified_by, comment"""
_CSV_ROWS = f"select {_CSV_VALUES} from catalogue"

_STAGED_LIST = """id, marketplace_sku, asin, im_sku, region, marketplace, level_1, level_2, level_3, level_4, level_5,
    parent_sku, marketplace_sales_table, channel, company, created_at, updated_at"""
_STAGED_SEARCH = ["marketplace_sku", "asin", "im_sku", "parent_sku", "region", "marketplace", "company"]


BODIES = {
    "feed_union": "select seller_sku, asin, region, sales_channel, purchase_date, title from projected",
    "feed_union_distinct": """select distinct seller_sku, asin, region, sales_channel from feed
        where order_status = 'Shipped' and sales_channel <> 'Non-Amazon'""",
    "feed_filtered": "select * from clean",
    "feed_distinct_sellers": "select distinct seller_sku, asin, region, sales_channel from clean",
    "feed_latest_title": "select * from newest",
    "feed_latest": "select * from sellers",
    "feed_of_regions": """select * from clean where region in (
        select region from hierarchy where marketplace_sku = 'SKU7')""",
    "feed_export": """select seller_sku as "SellerSKU", asin as "ASIN", region as "Region",
        sales_channel as "SalesChannel", strftime(date, '%Y-%m-%d %H:%M:%S') as "Date", title as "Title" from sellers""",
    "catalogue_mapped": f"select id, {_RECORD} from mapped_catalogue",
    "dedupe_last_mapping": f"select {_RECORD} from by_full_key",
    "map_full_key": "select * from mapped",
    "asin_base_stats": """select asin, count(distinct regexp_replace(im_sku, '[+]$', '')) as n_bases,
        max(regexp_replace(im_sku, '[+]$', '')) as base, coalesce(bool_or(im_sku like '%+'), false) as plus,
        count(*) filter (where im_sku <> '') as n_filled from catalogue group by asin""",
    "harmonise_im_sku": "select * exclude (bases, base, filled, plus) from harmonised",
    "harmonise_catalogue": """select c.id, c.asin, case when s.filled > 0 and s.bases = 1
          and (c.im_sku is null or c.im_sku in ('', s.base))
          then s.base || case when s.plus then '+' else '' end else c.im_sku end as im_sku
        from catalogue c left join (select asin, count(distinct regexp_replace(im_sku, '[+]$', '')) as bases,
            max(regexp_replace(im_sku, '[+]$', '')) as base, bool_or(im_sku like '%+') as plus,
            count(*) filter (where im_sku <> '') as filled from catalogue group by asin) s on s.asin = c.asin""",
    "first_per_im_sku": "select im_sku, level_1, linworks_title from first_complete",
    "enrich_im_sku": "select * from enriched",
    "fill_parent": "select * from parents",
    "override_exact": "select * from exact",
    "override_alternate": _override("parents", _ALT),
    "new_mapping": "select * from final",
    "split_update": f"select r.* from final r where exists (select 1 from catalogue c where c.marketplace_sku = r.marketplace_sku and c.asin = r.asin and c.region = r.region)",
    "split_create": f"select r.* from final r where not exists (select 1 from catalogue c where c.marketplace_sku = r.marketplace_sku and c.asin = r.asin and c.region = r.region)",
    "merge_catalogue": f"select {_C} from merged",
    "merge_bucketed": f"select {_C} from merged",
    "merge_rejects": f"""select distinct marketplace_sku, asin, {_STRING} as region from final
        where right(asin, 1) = '7'""",
    "merge_summary": f"""select count(id) as update_count, count(*) filter (where id is null) as create_count,
        cast(0 as bigint) as reject_count,
        count(*) filter (where id is not null and {_blank('before')}) as level_1_null_before,
        count(*) filter (where id is not null and not ({_blank('before')})) as level_1_not_null_before
        from candidates""",
    "stamp_catalogue": f"select {_C} from stamped",
    "stamp_and_insert": f"""select {_C} from stamped union all by name
        select (select max(id) from catalogue) + row_number() over (order by seller_sku, asin, region, sales_channel) as id,
          strftime(date, '%Y-%m-%d %H:%M:%S') as date, seller_sku as marketplace_sku, asin, region, sales_channel,
          title as amazon_title, {NOW} as created_at, {NOW} as updated_at
        from sellers s where not exists (select 1 from catalogue c
          where lower(c.marketplace_sku) = lower(s.seller_sku) and lower(c.sales_channel) = lower(s.sales_channel))""",
    "null_markers": "select id, im_sku, level_1 from catalogue",
    "csv_conform": _CSV_ROWS,
    "dump": f"""select l.* replace (
          case when n.seller_sku is not null then strftime(n.purchase_date, '%Y-%m-%d %H:%M:%S') else l.date end as date,
          case when n.seller_sku is not null then n.title else l.amazon_title end as amazon_title)
        from (select {_C} from catalogue union all by name
          select (select max(id) from catalogue) + row_number() over (order by {KEY3},
              im_sku nulls first, sales_channel nulls first, level_1 nulls first, linworks_title nulls first,
              modified_by nulls first, comment nulls first) as id,
            {_CSV}, {NOW} as created_at, {NOW} as updated_at from ({_CSV_ROWS})) l
        left join newest n on lower(n.seller_sku) = lower(l.marketplace_sku)
          and lower(n.sales_channel) = lower(l.sales_channel)""",
    "dump_rejects": f"select {_CSV_VALUES} from (select * replace (null as asin) from catalogue where id % 11 = 0)",
    "dump_by_line": f"""select l.* replace (
          case when n.seller_sku is not null then strftime(n.purchase_date, '%Y-%m-%d %H:%M:%S') else l.date end as date,
          case when n.seller_sku is not null then n.title else l.amazon_title end as amazon_title)
        from (select {_C} from catalogue union all by name
          select (select max(id) from catalogue) + row_number() over (order by c.id desc) as id,
            {_CSV_VALUES}, {NOW} as created_at, {NOW} as updated_at from catalogue c) l
        left join newest n on lower(n.seller_sku) = lower(l.marketplace_sku)
          and lower(n.sales_channel) = lower(l.sales_channel)""",
    "last_line_wins": """select marketplace_sku, region, arg_min({'v': im_sku}, id).v as im_sku,
          arg_min({'v': comment}, id).v as comment
        from catalogue where im_sku <> '' group by all""",
    "quality_metrics": """select count(*) filter (where im_sku is null) as null_im_sku,
        count(*) filter (where parent_sku is null) as null_parent_sku,
        count(*) filter (where level_1 is null) as lin_category_to_be_mapped,
        count(*) filter (where linworks_title is null) as lin_title_to_be_mapped,
        count(distinct im_sku) as unique_im_sku, count(distinct marketplace_sku) as unique_marketplace_sku,
        count(distinct parent_sku) as unique_parent_sku, count(distinct region) as unique_regions from catalogue""",
    "search_catalogue": "select * from catalogue where " + " and ".join(
        "(" + " or ".join(
            f"coalesce(contains(lower({c}), '{w}'), false)" for c in (
                "marketplace_sku", "asin", "im_sku", "region", "parent_sku", "sales_channel", "level_1"))
        + ")" for w in ("m-sku1", "amazon.co")),
    "search_indexed": _search("catalogue", _C, [
        "marketplace_sku", "asin", "im_sku", "region", "parent_sku", "sales_channel", "level_1"], ["sku1", "uk", "5"]),
    "metrics_of_sketches": """select count(*) filter (where im_sku is null) as null_im_sku,
        count(*) filter (where parent_sku is null) as null_parent_sku,
        count(*) filter (where level_1 is null) as lin_category_to_be_mapped,
        count(*) filter (where linworks_title is null) as lin_title_to_be_mapped,
        true as unique_im_sku, true as unique_marketplace_sku, true as unique_parent_sku, true as unique_regions
        from catalogue""",
    "staging_page": f"select {_STAGED_LIST} from staging order by created_at desc, id desc limit 25 offset 50",
    "staging_page_indexed": f"select {_STAGED_LIST} from staging order by created_at desc, id desc limit 25 offset 1000",
    "staging_search": _search("staging", _STAGED_LIST, _STAGED_SEARCH, ["sku1", "im3", "uk"]),
    "staging_search_indexed": _search("staging", _STAGED_LIST, _STAGED_SEARCH, ["sku1", "im3", "uk"]),
    "staging_facets": " union all ".join(
        f"select '{c}' as facet, {c} as value, count(*) as n from staging group by {c}"
        for c in ("region", "marketplace", "channel", "company")),
    "facet_region": "select region as value, count(*) as n from catalogue group by 1",
    "facet_channel": "select sales_channel as value, count(*) as n from catalogue group by 1",
    "facet_filtered": f"select {_C} from catalogue where region = 'DE' and sales_channel = 'Amazon.it'",
    "date_facet": f"""select {_C} from catalogue where created_at >= timestamp '2024-05-25'
        and created_at < timestamp '2024-06-02'""",
    "date_drilldown": "select cast(date_trunc('month', created_at) as timestamp) as period, count(*) as n from catalogue group by 1",
    "list_page": """select id, marketplace_sku, asin, im_sku, parent_sku, region, sales_channel, level_1,
        linworks_title, modified_by, created_at, updated_at from catalogue
        order by created_at desc, id desc limit 25 offset 25""",
    "list_page_indexed": """select id, marketplace_sku, asin, im_sku, parent_sku, region, sales_channel, level_1,
        linworks_title, modified_by, created_at, updated_at from catalogue
        order by created_at desc, id desc limit 25 offset 150""",
    "list_page_after": """select id, marketplace_sku, asin, im_sku, parent_sku, region, sales_channel, level_1,
        linworks_title, modified_by, created_at, updated_at from catalogue
        where (created_at, id) < (timestamp '2024-06-01', 900) order by created_at desc, id desc limit 25""",
    "sample_rows": f"select {_C} from catalogue where level_1 is not null order by id limit 3",
    "edited_ids": f"select {_C} from catalogue where id in (select id from edits)",
    "match_count": "select count(*) as n from catalogue where lower(im_sku) = 'im7'",
    "json_rows": f"""select cast(to_json({{{', '.join(
            f"'{c}': " + (f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')" if c.endswith('_at') else c)
            for c in CATALOGUE)}}}) as varchar) as record from catalogue""",
    "staging_last": "select * from last_staged",
    "publish_actions": """select a.marketplace_sku, a.region, a.action, exists (select 1 from hierarchy h
        where h.marketplace_sku = a.marketplace_sku and h.region = a.region) as exists, a.n_rows from actions a""",
    "publish_summary": """select count(*) filter (where action in ('upsert', 'unmap')) as rows_upserted_or_unmapped,
        count(*) filter (where action = 'skip') as rows_skipped_due_to_missing_fields,
        count(*) filter (where action = 'fail') as rows_failed_upsert from actions""",
    "publish_summary_widths": """select count(*) filter (where action in ('upsert', 'unmap')) as rows_upserted_or_unmapped,
        count(*) filter (where action = 'skip') as rows_skipped_due_to_missing_fields,
        count(*) filter (where action = 'fail') as rows_failed_upsert from narrow_actions""",
    "staging_remaining_widths": f"""select {', '.join(STAGING)} from staging s where not exists (
        select 1 from narrow_actions a where a.action not in ('skip', 'fail')
        and a.marketplace_sku = s.marketplace_sku and a.region = s.region)""",
    "hierarchy_published_widths": f"""select {_H} from (
          select h.* replace (coalesce(p.parent_sku, h.parent_sku) as parent_sku)
          from hierarchy h left join (select im_sku, arg_max(parent_sku, (marketplace_sku, region)) as parent_sku
            from narrow_actions where action = 'upsert' and not ({_blank('parent_sku')}) group by im_sku) p
            on p.im_sku = h.im_sku) h
        where not exists (select 1 from narrow_actions a where a.action in ('upsert', 'unmap')
          and a.marketplace_sku = h.marketplace_sku and a.region = h.region)
        union all select {_H} from (select * replace (coalesce(
            last_value(case when not ({_blank('parent_sku')}) then parent_sku end ignore nulls)
              over (partition by im_sku order by marketplace_sku, region
                rows between 1 following and unbounded following), parent_sku) as parent_sku)
          from narrow_actions where action = 'upsert')""",
    "hierarchy_published_defaults": f"""select {_H} from reparented h where not exists (select 1 from actions a
        where a.action <> 'skip' and a.marketplace_sku = h.marketplace_sku and a.region = h.region)
        union all select {_H} from (select * replace ('RDX' as company, 'Amazon' as channel,
          'stg_tr_amazon_raw' as marketplace_sales_table) from upserts)""",
    "hierarchy_unmap": f"""select {_H} from hierarchy h where not exists (select 1 from actions a
        where a.action = 'unmap' and a.marketplace_sku = h.marketplace_sku and a.region = h.region)""",
    "hierarchy_upsert": f"""select {_H} from hierarchy h where not exists (select 1 from actions a
        where a.action = 'upsert' and a.marketplace_sku = h.marketplace_sku and a.region = h.region)
        union all select {_H} from actions where action = 'upsert'""",
    "hierarchy_parent": f"select {_H} from reparented",
    "staging_remaining": f"""select {', '.join(STAGING)} from staging s where not exists (select 1 from actions a
        where a.action <> 'skip' and a.marketplace_sku = s.marketplace_sku and a.region = s.region)""",
    "hierarchy_published": f"""select {_H} from reparented h where not exists (select 1 from actions a
        where a.action <> 'skip' and a.marketplace_sku = h.marketplace_sku and a.region = h.region)
        union all select {_H} from upserts""",
    "edit_upsert": f"select {_C} from set_rows",
    "edit_propagate_parent": f"select {_spread_columns('parent_sku', False)} from set_rows t left join keyed_im k on k.key = lower(t.im_sku)",
    "edit_propagate_parent_hierarchy": """select t.* replace (
        case when k.key is not null then k.value else t.parent_sku end as parent_sku)
        from hierarchy t left join keyed_im_exact k on k.key = t.im_sku""",
    "edit_attribution": f"select {_spread_columns(None, True)} from set_rows t left join keyed_im k on k.key = lower(t.im_sku)",
    "edit_reference_fill": f"select {_C}, created from filled",
    "edit_propagate_asin": f"select {_spread_columns('im_sku', True)} from set_rows t left join keyed_asin k on k.key = t.asin",
    "edit_stage": f"select {', '.join(STAGING)} from restaged",
    "edit_rejects": "select edit_seq, id, reason from checked where reason is not null",
    "edit_summary": "select * from messages",
    "edit_responses": f"""select e.id, e.marketplace_sku, e.asin, e.im_sku, e.parent_sku, e.region, e.sales_channel,
        e.level_1, e.linworks_title, e.comment, e.comment_by_finance, {', '.join(f'e.{c}' for c in ATTR)},
        o.created, m.message
        from edited e join filled o on o.id = e.id join messages m on m.edit_seq = o.edit_seq""",
    "edits_applied": f"select {_C} from edited",
    "edit_changes": f"select {_C} from edited except select {_C} from catalogue",
    "edit_changes_staging": f"select {', '.join(STAGING)} from restaged where id in (select id from filled)",
    "edit_changes_hierarchy": "select key as im_sku, value as parent_sku from keyed_im_exact where key is not null",
}


def oracle_sql() -> dict[str, str]:
    return {name: _sql(body) for name, body in BODIES.items()}
