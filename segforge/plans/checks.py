"""Queries of the element table and of the rules of the standards, with their SQL over the tree of each payload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segforge.io import table
from segforge.operators import elements as E

Query = Callable[[SparkSession, str], DataFrame]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TREE = r"""d as (select rec_id, payload::json as j from xliff_records where payload is not null and json_valid(payload)),
n as (select rec_id, t.id, t.parent, t.key, t.type, t.atom, t.fullkey from d, json_tree(d.j) t),
m as (select n.*, case when p.type = 'ARRAY' then p.key else n.key end as name, p.type as held from n left join n p on p.rec_id = n.rec_id and p.id = n.parent),
w as (select rec_id, coalesce(json_extract_string(j, '$.xliff.version'), json_extract_string(j, '$.version')) as version from d),
o as (select rec_id, id, name as element, case when name = 'file' then '' else regexp_extract(fullkey, '^\$\.xliff\.file(\[[0-9]+\])?', 0) end as scope from m where type = 'OBJECT' and name is not null),
e as (select rec_id, version, scope, id, element, '' as attribute, null::varchar as value from o join w using (rec_id) union all
 select m.rec_id, version, scope, o.id, o.element, m.key, case when type = 'VARCHAR' then m.atom ->> '$' else m.atom::varchar end from m join o on o.rec_id = m.rec_id and o.id = m.parent join w on w.rec_id = m.rec_id where held = 'OBJECT' and type in ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE'))"""


def element_attributes(s: SparkSession, d: str) -> DataFrame:
    """How often each attribute occurs, and in how many values."""
    t = E.elements(table(s, d, "xliff_records"))
    return t.groupBy(F.substring("version", 1, 1).alias("v"), "element", "attribute").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.countDistinct("rec_id").alias("records"))


def rule_violations(s: SparkSession, d: str) -> DataFrame:
    """Violations of the rules, by rule and document."""
    v = E.violations(E.elements(table(s, d, "xliff_records")))
    return v.groupBy("rule_id", "rec_id").agg(F.count("*").alias("n"), F.min("detail").alias("first_detail"))


def document_languages(s: SparkSession, d: str) -> DataFrame:
    return E.xliff_languages(E.elements(table(s, d, "xliff_records")))


def _values(table_: dict[str, str]) -> str:
    return "(values " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in table_.items()) + ")"


def _sql_violations() -> str:
    required = "(values " + ", ".join(f"({_q(f'v{r.version}-{r.element}')}, {_q(r.attribute)})" for r in E.RULES if r.kind == "required") + ")"
    unique = {k: "" for k in E.rule_value(E.RULES, "unique")}
    return f"""with {_TREE}, k as (select *, 'v' || version[1] || '-' || element as ek, 'v' || version[1] || '-' || element || '-' || attribute as ak from e),
p as (select ak || '-pattern' as rule_id, rec_id, value as detail from k join {_values(E.rule_value(E.RULES, 'pattern'))} r(rk, x) on ak = rk where value is not null and not regexp_full_match(value, x)),
q as (select distinct rec_id, id, ek from k), c as (select distinct rec_id, element from k where attribute = '' and element in ('source', 'target')),
r as (select ek || '-' || a || '-required' as rule_id, q.rec_id, a as detail from q join {required} t(re, a) on ek = re
 where not exists (select 1 from k where k.rec_id = q.rec_id and k.id = q.id and k.attribute = a) and not exists (select 1 from c where c.rec_id = q.rec_id and c.element = a)),
u as (select ak || '-unique' as rule_id, rec_id, value as detail from k join {_values(unique)} t(rk, x) on ak = rk group by ak, rec_id, scope, value having count(*) > 1),
f as (select ak || '-reference' as rule_id, rec_id, value as detail from k join {_values(E.rule_value(E.RULES, 'reference'))} t(rk, x) on ak = rk where not exists (select 1 from k i where i.rec_id = k.rec_id and i.element = x and i.attribute in ('id', 'phase-name') and i.value = regexp_replace(k.value, '^.*[#/]', '')))
select rule_id, rec_id, count(*) as n, min(detail) as first_detail from (select * from p union all select * from r union all select * from u union all select * from f) group by 1, 2"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (element_attributes, rule_violations, document_languages)}


def oracle_sql() -> dict[str, str]:
    return {
        "element_attributes": f"with {_TREE} select version[1] as v, element, attribute, count(*) as n, count(distinct value) as n_values, count(distinct rec_id) as records from e group by 1, 2, 3",
        "rule_violations": _sql_violations(),
        "document_languages": f"with {_TREE} select rec_id, min(case when attribute = 'source-language' and element in ('file', 'xliff') or attribute = 'srcLang' and element = 'xliff' then value end) as source, min(case when attribute = 'target-language' and element in ('file', 'xliff') or attribute = 'trgLang' and element = 'xliff' then value end) as target from e group by 1",
    }
