"""The nested payloads of raw_records in SQL, for the oracles."""

from __future__ import annotations

#: Records of a source, and the part of their payload that holds the data: marks in front are no part of it, and either may be text that holds JSON.
OPENED = """with t as (select distinct record_id, ltrim(replace(payload, chr(65279), ''), ' ' || chr(10) || chr(9) || chr(13)) as p from raw_records where source_id = '{source}' and record_id is not null),
        u as (select record_id, case when json_type(p) = 'VARCHAR' then json_extract_string(p, '$') else p end as p from t where json_valid(p)),
        own as (select record_id, case when json_type(p, '$.{part}') = 'VARCHAR' then case when json_valid(json_extract_string(p, '$.{part}')) then json_extract_string(p, '$.{part}') end else json_extract(p, '$.{part}')::varchar end as x from u where json_valid(p)),"""

#: CTEs that end in facts: record_id, tax, tag, unit, position and the fact; a fact that stands alone is at position 0.
FACTS = OPENED.format(source="sec-companyfacts", part="body") + """
        fa as (select record_id, json_extract(x, '$.facts') as f from own), fb as (select record_id, f, unnest(json_keys(f)) as tax from fa where json_type(f) = 'OBJECT'),
        fc as (select record_id, tax, json_extract(f, '$."' || tax || '"') as f from fb), fd as (select record_id, tax, f, unnest(json_keys(f)) as tag from fc where json_type(f) = 'OBJECT'),
        fe as (select record_id, tax, tag, json_extract(f, '$."' || tag || '".units') as f from fd), ff as (select record_id, tax, tag, f, unnest(json_keys(f)) as unit from fe where json_type(f) = 'OBJECT'),
        fg as (select record_id, tax, tag, unit, json_extract(f, '$."' || unit || '"') as f from ff),
        fh as (select record_id, tax, tag, unit, f, unnest(range(case when json_type(f) = 'ARRAY' then json_array_length(f)::bigint else 1 end)) as position from fg),
        facts as (select record_id, tax, tag, unit, position, case when json_type(f) = 'ARRAY' then json_extract(f, '$[' || position || ']') else f end as fact from fh
          where json_type(case when json_type(f) = 'ARRAY' then json_extract(f, '$[' || position || ']') else f end) = 'OBJECT')"""
#: CTEs that end in nodes: the innermost objects with their places.
NODES = (
    FACTS
    + """, segs as (select record_id, tax, tag, unit, position, json_extract(fact, '$.segments') as g from facts where json_type(fact, '$.segments') is not null),
        segs2 as (select record_id, tax, tag, unit, position, g, unnest(range(case when json_type(g) = 'ARRAY' then json_array_length(g)::bigint else 1 end)) as sub from segs),
        """
    + OPENED.format(source="sec-submissions", part="body").replace("with t as", "t1 as").replace("u as (", "u1 as (").replace("from t where", "from t1 where").replace("own as (", "subs as (").replace("from u where", "from u1 where")
    + OPENED.format(source="deribit-dvol", part="result").replace("with t as", "t2 as").replace("u as (", "u2 as (").replace("from t where", "from t2 where").replace("own as (", "vols as (").replace("from u where", "from u2 where")
    + """ ra as (select record_id, json_extract(x, '$.filings.recent') as f from subs), rb as (select record_id, f, unnest(range(json_array_length(json_extract(f, '$.accessionNumber'))::bigint)) as position from ra where json_type(json_extract(f, '$.accessionNumber')) = 'ARRAY'),
        rl as (select record_id, f, unnest(range(json_array_length(f)::bigint)) as position from ra where json_type(f) = 'ARRAY'),
        rf as (select record_id, json_extract(x, '$.filings.files') as f from subs), rg as (select record_id, f, unnest(range(json_array_length(f)::bigint)) as position from rf where json_type(f) = 'ARRAY'),
        va as (select record_id, case when json_type(x, '$.data') = 'VARCHAR' then json_extract_string(x, '$.data')::json else json_extract(x, '$.data') end as a from vols),
        vb as (select record_id, a, unnest(range(json_array_length(a)::bigint)) as position from va where json_type(a) = 'ARRAY'),
        nodes as (select record_id, tax as level1, tag as level2, unit as level3, position as item_no, -1 as sub_no from facts
          union all select record_id, tax, tag, unit, position, sub from segs2 where json_type(case when json_type(g) = 'ARRAY' then json_extract(g, '$[' || sub || ']') else g end) <> 'NULL'
          union all select record_id, 'filings', 'recent', json_extract_string(f, '$.accessionNumber[' || position || ']'), position, -1 from rb where json_extract_string(f, '$.accessionNumber[' || position || ']') is not null
          union all select record_id, 'filings', 'recent', json_extract_string(f, '$[' || position || '].accessionNumber'), position, -1 from rl where json_extract_string(f, '$[' || position || '].accessionNumber') is not null
          union all select record_id, 'filings', 'files', json_extract_string(f, '$[' || position || '].name'), position, -1 from rg where json_type(json_extract(f, '$[' || position || ']')) = 'OBJECT'
          union all select record_id, 'result', 'data', json_extract_string(a, '$[' || position || '][0]'), position, -1 from vb where json_type(json_extract(a, '$[' || position || ']')) = 'ARRAY')"""
)
