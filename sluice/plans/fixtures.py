"""Tables of the domain's shapes, derived from the driver tables by SQL that both engines read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    "fx_documents": """select o_orderkey as document_id,
 concat('http://www.court.example/DocketPDF/', cast(16 + o_custkey % 10 as string), '/', cast(16 + o_custkey % 10 as string), '-', cast(o_custkey as string), '/', cast(o_orderkey as string), '/brief.pdf') as url,
 concat('SUPREMECOURT/www.court.example/public/', cast(16 + o_custkey % 10 as string), '-', cast(o_custkey as string), '.html') as docket_url,
 case o_orderkey % 4 when 0 then 'Brief amicus curiae of filer filed.' when 1 then 'BRIEF AMICI CURIAE of filers filed.' when 2 then 'Reply brief amicus curiae' else 'Motion to extend time' end as label,
 o_orderdate as filed_at, o_orderkey % 7 <> 0 as complete_list, o_orderkey % 100 = 0 as needed_ocr,
 concat('Lawyer ', cast(o_custkey as string)) as counsel_of_record from orders""",
    "fx_dockets": """select l_orderkey as document_id, cast(18 + l_suppkey % 7 as int) as year, cast(l_partkey as int) as number,
 case when l_returnflag = 'R' then 'R' else 'P' end as position, l_linenumber as line from lineitem where l_linenumber <= 2""",
    "fx_filers": """select l_orderkey as document_id, l_linenumber as line,
 case (l_partkey + l_linenumber) % 6 when 0 then concat('The ', p_name, ' Association') when 1 then concat(p_name, ' Associaton, Inc.') when 2 then concat(p_name, ' & National Foundation (PNF)') when 3 then concat(p_name, ' and natl fdn') when 4 then concat(upper(p_name), ' -- Center LLC') else concat(p_name, ' Institute''s group') end as name,
 case l_suppkey % 5 when 0 then 'individual' when 1 then 'government' else 'organization' end as category
 from lineitem join part on l_partkey = p_partkey""",
    "fx_lawyers": """select o_orderkey as document_id, concat('Lawyer ', cast(o_custkey + k as string)) as name, case when k = 0 then 'Counsel of Record' else '' end as role,
 case when o_custkey % 11 = 0 then '' else concat('Firm ', cast(o_custkey % 50 as string)) end as employer from orders cross join (values (0),(1),(2)) t(k) where k <= o_orderkey % 3""",
    "fx_proceedings": """select page_id, cast(2 * k + h as int) as pos, h as is_link, src from
 (select o_custkey as page_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as k, o_orderkey as src from orders) r cross join (values (0),(1)) t(h)""",
    "fx_decisions": """select event_id as decision_id, ts, least(user_id, cast(event_id % 151 as bigint)) as left_id, greatest(user_id, cast(event_id % 151 as bigint)) as right_id,
 event_type in ('purchase','click') as is_match, value / 1000.0 as score from events where user_id <> event_id % 151""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, used = FIXTURES[name], {}
    for table in ("orders", "lineitem", "part", "events"):
        sql, n = re.subn(rf"\b(from|join) {table}\b", rf"\1 {{{table}}}", sql)
        if n:
            used[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql, **used)


def with_fixtures(sql: str) -> str:
    """The SQL with the fixtures it names put before it."""
    named = [n for n in FIXTURES if re.search(rf"\b{n}\b", sql)]
    ctes = ",\n".join(f"{n} as ({FIXTURES[n]})" for n in named)
    body = sql.strip()
    if not named:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{body[14:].strip()}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
