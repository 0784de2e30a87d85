"""SQL counterparts of the registered queries, written for DuckDB over the same tables.

They state each result independently: joins, windows and list functions of SQL, nothing generated from the
Spark side but word lists and parameters.
"""

from __future__ import annotations

from spendloom.functions.text import STOP_WORDS
from spendloom.operators.audit import ENGINE_WORDS, FORBIDDEN_WORDS
from spendloom.operators.evaluation import BENCHMARKS
from spendloom.plans.registry import TERMS

_DATES = (
    "published_date", "closing_date", "award_published_date", "award_date", "proceed_date",
    "effectivity_date", "end_date",
)

# Expressions over the joined star schema, one per award column.
_VALUES = {
    "government_branch": "l_returnflag",
    "classification": "p_type",
    "org_group": "c_mktsegment",
    "procurement_mode": "o_orderpriority",
    "awardee_size": "case when s_suppkey % 10 = 0 then null when s_acctbal < 2500 then 'Micro' "
    "when s_acctbal < 5000 then 'Small' when s_acctbal < 7500 then 'Medium' else 'Large' end",
    "quarter": "concat(cast(year(l_shipdate) as varchar), '-Q', cast(quarter(l_shipdate) as varchar))",
    "agency": "c_name",
    "region": "r_name",
    "province": "n_name",
    "city": "concat(n_name, ' City')",
    "contract_amount": "cast(cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(4,2))) "
    "as decimal(15,2))",
    "approved_budget": "cast(l_extendedprice as decimal(15,2))",
    "item_budget": "cast(l_extendedprice as decimal(15,2))",
    "published_date": "cast(o_orderdate as date)",
    "closing_date": "cast(o_orderdate as date) + 20",
    "award_published_date": "cast(l_shipdate as date) + 1",
    "award_date": "cast(l_shipdate as date)",
    "proceed_date": "cast(l_shipdate as date) + 5",
    "effectivity_date": "cast(l_shipdate as date) + 10",
    "end_date": "cast(l_shipdate as date) + 40",
    "awardee": "s_name",
    "award_title": "concat('Award of ', p_name)",
    "notice_title": "concat(p_type, ' ', p_name)",
    "item_name": "p_name",
    "item_desc": "concat(p_brand, ' ', p_type, ' size ', cast(p_size as varchar))",
    "unspsc_code": "p_brand",
    "unspsc_desc": "p_type",
    "quantity": "l_quantity",
    "line_item_no": "l_linenumber",
    "contract_duration": "30",
    "award_ref": "concat(cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar))",
}

_FROM = """
    from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
    join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""


def _columns(values: dict[str, str]) -> str:
    return ",\n    ".join(f"{expr} as {name}" for name, expr in values.items())


_AWARDS = f"""awards as (
    select md5(lower(notice_title || item_name || item_desc)) as item_id, * from (
    select {_columns(_VALUES)} {_FROM}) x
)"""


def _bronze() -> str:
    text = {name: f"cast({expr} as varchar)" for name, expr in _VALUES.items()}
    for name in _DATES:
        text[name] = f"cast(date_diff('day', date '1899-12-30', {_VALUES[name]}) as varchar)"
    text["award_date"] = f"{text['award_date']} || case when l_orderkey % 11 = 5 then '.5' else '' end"
    text["closing_date"] = f"case when l_orderkey % 13 = 6 then 'NULL' else {text['closing_date']} end"
    text["contract_amount"] = (
        "case when l_orderkey % 4 = 0 then 'NULL' when l_orderkey % 97 = 1 then null "
        f"when l_orderkey % 53 = 2 then '0' else {text['contract_amount']} end"
    )
    text["item_budget"] = f"case when l_orderkey % 5 = 1 then '-1' else {text['item_budget']} end"
    text["contract_duration"] = f"case when l_orderkey % 6 = 1 then '0' else {text['contract_duration']} end"
    title = text["notice_title"]
    text["notice_title"] = (
        f"case when l_orderkey % 7 = 1 then ' ' || replace({title}, ' ', '  ') "
        f"when l_orderkey % 17 = 1 then chr(160) || {title} || ' ' else {title} end"
    )
    text["item_desc"] = f"case when l_orderkey % 19 = 3 then 'NULL' else {text['item_desc']} end"
    return f"""keyed as (select l_orderkey as k, {_columns(text)} {_FROM}),
bronze as (
    select * exclude (k) from keyed union all select * exclude (k) from keyed where k % 10 = 3
)"""


_BRONZE = _bronze()
_HAS_AWARD = "contract_amount is not null and contract_amount != 'NULL'"
_DEDUPED = f"""{_BRONZE},
raw as (select * from bronze where {_HAS_AWARD}),
deduped as (select distinct * from raw)"""


def _typed() -> str:
    out = {}
    for name in _VALUES:
        if name in _DATES:
            out[name] = f"cast(date '1899-12-30' + interval (try_cast({name} as integer)) day as date)"
        elif name in ("contract_amount", "approved_budget"):
            out[name] = f"cast({name} as decimal(15,2))"
        elif name == "item_budget":
            out[name] = "case when try_cast(item_budget as double) = -1 then null else cast(item_budget as decimal(15,2)) end"
        elif name == "quantity":
            out[name] = "cast(quantity as double)"
        elif name == "line_item_no":
            out[name] = "cast(line_item_no as integer)"
        elif name == "contract_duration":
            out[name] = "case when contract_duration = '0' then null else try_cast(contract_duration as integer) end"
        elif name in ("agency", "notice_title", "item_name", "item_desc", "award_title", "awardee"):
            out[name] = f"nullif(trim(regexp_replace({name}, '\\s+', ' ', 'g')), 'NULL')"
        else:
            out[name] = f"nullif({name}, 'NULL')"
    return f"""{_DEDUPED},
typed as (select {_columns(out)} from deduped where try_cast(contract_amount as double) != 0),
zero as (select * from deduped where try_cast(contract_amount as double) = 0)"""


_TYPED = _typed()


def _plain(columns: list[str]) -> str:
    """Dates as text, decimals as double, integers as bigint."""
    shown = []
    for name in columns:
        if name in _DATES:
            shown.append(f"cast({name} as varchar) as {name}")
        elif name in ("contract_amount", "approved_budget", "item_budget"):
            shown.append(f"cast({name} as double) as {name}")
        elif name in ("line_item_no", "contract_duration"):
            shown.append(f"cast({name} as bigint) as {name}")
        else:
            shown.append(name)
    return ", ".join(shown)


_ITEM_COLUMNS = "notice_title, item_name, item_desc, unspsc_code, unspsc_desc"


def _items(source: str, name: str) -> str:
    order = ", ".join(f"{c} asc nulls last" for c in _ITEM_COLUMNS.split(", "))
    return f"""{name} as (
    select item_id, {_ITEM_COLUMNS} from (
        select *, row_number() over (partition by item_id order by {order}) as rn
        from (select md5(lower(notice_title || item_name || item_desc)) as item_id, {_ITEM_COLUMNS} from {source})
        where item_id is not null)
    where rn = 1
)"""


_PARTS = """parts as (
    select md5(lower(notice_title || item_name || item_desc)) as item_id, * from (
        select concat(p_type, ' ', p_name) as notice_title, p_name as item_name,
            concat(p_brand, ' ', p_type, ' size ', cast(p_size as varchar)) as item_desc,
            p_brand as unspsc_code, p_type as unspsc_desc, p_partkey from part) x
),
catalogue as (
    select * exclude (rn, p_partkey) from (
        select *, row_number() over (partition by item_id order by p_partkey) as rn from parts) where rn = 1
),
vectors as (
    select item_id, embedding::double[] as embedding, label from (
        select item_id, embedding, label, row_number() over (partition by item_id order by vec_id) as rn
        from parts join embeddings on p_partkey = vec_id) where rn = 1
),
label_queries as (
    select cast(label as bigint) as query_id, notice_title as query_text, embedding::double[] as query_vector,
        item_id as target_item_id from (
        select label, notice_title, embedding, item_id, row_number() over (partition by label order by vec_id) as rn
        from parts join embeddings on p_partkey = vec_id) where rn = 1
)"""

_STOPPED = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens(text: str) -> str:
    return (
        f"list_filter(string_split_regex(strip_accents(lower(coalesce({text}, ''))), '[^a-z]+'), "
        f"lambda t: t <> '' and t not in ({_STOPPED}))"
    )


def _bm25(docs: str, doc_id: str, text: str, queries: str, k: int, scope: str | None, out: str) -> str:
    """CTEs that end in ``out(query_id, item_id, score, rank)``."""
    inside = f"and item_id in ({scope})" if scope else ""
    cleaned = r"trim(regexp_replace(query_text, '[^\p{L}\p{N}\s]', ' ', 'g'))"
    return f"""docs as (select {doc_id} as item_id, {_tokens(text)} as tokens from {docs}),
stats as (
    select count(*) as n_items, sum(len(tokens)) / count(*) filter (len(tokens) > 0) as avg_len from docs
),
postings as (
    select term, item_id, count(*) as tf, doc_len from (
        select item_id, len(tokens) as doc_len, unnest(tokens) as term from docs)
    group by term, item_id, doc_len
),
terms as (select term, count(*) as df from postings group by term),
asked as (
    select distinct query_id, term from (
        select query_id, unnest({_tokens(cleaned)}) as term from {queries})
),
{out}_scores as (
    select query_id, item_id, round(sum(
        ln((n_items - df + 0.5::double) / (df + 0.5::double) + 1.0::double)
        * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * doc_len / avg_len)))), 6) as score
    from asked join postings using (term) join terms using (term) cross join stats
    where true {inside} group by query_id, item_id
),
{out} as (
    select query_id, item_id, score, rank from (
        select *, row_number() over (partition by query_id order by score desc, item_id) as rank
        from {out}_scores) where rank <= {k}
)"""


def _cosine(k: int, scope: str | None, queries: str = "label_queries") -> str:
    inside = f"where item_id in ({scope})" if scope else ""
    return f"""vector_hits as (
    select query_id, item_id, score, rank from (
        select *, row_number() over (partition by query_id order by score desc, item_id) as rank from (
            select query_id, item_id,
                round(list_cosine_similarity(query_vector, embedding), 6) as score
            from {queries} cross join vectors {inside})) where rank <= {k}
)"""


def _rrf(k: int, v: str = "vector_hits", w: str = "keyword_hits", out: str = "fused") -> str:
    return f"""{out} as (
    select query_id, item_id, final_rank, score, source,
        case when n_v > 0 and n_w > 0 then round(rrf, 9) end as rrf_score from (
        select *, row_number() over (
                partition by query_id order by rrf desc, rv asc nulls last, rw asc nulls last) as final_rank,
            count(rv) over (partition by query_id) as n_v, count(rw) over (partition by query_id) as n_w
        from (
            select coalesce(v.query_id, w.query_id) as query_id, coalesce(v.item_id, w.item_id) as item_id,
                v.rank as rv, w.rank as rw, coalesce(v.score, w.score) as score,
                case when v.rank is not null then 'vector' else 'keyword' end as source,
                coalesce(1.0::double / (60 + v.rank), 0) + coalesce(1.0::double / (60 + w.rank), 0) as rrf
            from {v} v full outer join {w} w on v.query_id = w.query_id and v.item_id = w.item_id))
    where final_rank <= {k}
)"""


def _scope(region: str, agency: str) -> str:
    return (
        f"select item_id from awards where lower(region) like '%{region}%' "
        f"and lower(agency) like '%{agency}%'"
    )


_ITEM_TEXT = "concat_ws(' ', notice_title, item_name, item_desc)"
_SAMPLE = "award_ref, agency, awardee, contract_amount, award_date, region, notice_title, item_name"
_SAMPLE_ORDER = (
    "contract_amount desc, award_ref, agency, awardee, award_date, region, notice_title, item_name"
)
_SAMPLE_PLAIN = (
    "award_ref, agency, awardee, cast(contract_amount as double) as contract_amount, "
    "cast(award_date as varchar) as award_date, region, notice_title, item_name"
)

_RINGS = """rings as (
    select * from awards where lower(region) like '%a%'
    and item_id in (select item_id from catalogue where lower(item_name) like '%ring%')
)"""


def _hybrid_ctes() -> str:
    scope = _scope("asia", "customer#0000000")
    return f"""with {_AWARDS}, {_PARTS},
{_bm25("catalogue", "item_id", _ITEM_TEXT, "label_queries", 200, scope, "keyword_hits")},
{_cosine(200, scope)}, {_rrf(10)},
pool as (select query_id, item_id from vector_hits union select query_id, item_id from keyword_hits),
scoped as (
    select * from awards where lower(region) like '%asia%' and lower(agency) like '%customer#0000000%'
),
hits as (select query_id, scoped.* from pool join scoped using (item_id))"""


def _discovery_ctes() -> str:
    scope = _scope("europe", "customer#0000001")
    return f"""with {_AWARDS}, {_PARTS},
lookups as (
    select p_type as query_id, concat_ws(' ', min(p_name), p_type) as query_text from part group by p_type
    union all select r_name, 'nuclear submarine' from region
),
{_bm25("catalogue", "item_id", _ITEM_TEXT, "lookups", 200, scope, "keyword_hits")},
scoped as (
    select * from awards where lower(region) like '%europe%' and lower(agency) like '%customer#0000001%'
),
hits as (
    select query_id, scoped.* from keyword_hits join scoped using (item_id)
    union all
    select query_id, scoped.* from lookups cross join scoped
    where query_id not in (select query_id from keyword_hits)
),
shown as (select query_id, item_id from keyword_hits where rank <= 5),
sample_hits as (
    select query_id, scoped.* from shown join scoped using (item_id)
    union all
    select query_id, scoped.* from lookups cross join scoped
    where query_id not in (select query_id from keyword_hits)
)"""


_TOTALS = """coalesce(cast(sum(contract_amount) as double), 0) as total_spend, count(*) as award_count,
    round(case when count(*) > 0 then cast(sum(contract_amount) as double) / count(*) else 0 end, 4) as avg_spend"""


def _top(source: str, column: str, key: str = "") -> str:
    """Five values of a column by spend, per key."""
    lead = f"{key}, " if key else ""
    part = f"partition by {key} " if key else ""
    return f"""select {lead}position, {column}, award_count, spend from (
        select {lead}{column}, count(*) as award_count, cast(sum(contract_amount) as double) as spend,
            row_number() over ({part}order by sum(contract_amount) desc nulls last, {column} asc nulls last)
            as position
        from {source} group by {lead}{column}) where position <= 5"""


def _shape(group: str, where: str = "true", limit: int | None = None, average: bool = False) -> str:
    tail = f"order by total_spend desc nulls last, {group} nulls last limit {limit}" if limit else ""
    mean = ", cast(round(cast(sum(contract_amount) as decimal(38,8)) / count(*), 2) as double) as avg_contract"
    return f"""with {_AWARDS} select {group}, count(*) as contracts,
        cast(sum(contract_amount) as double) as total_spend{mean if average else ""}
        from awards where {where} group by {group} {tail}"""


def _point(where: str) -> str:
    return f"""with {_AWARDS} select coalesce(cast(sum(contract_amount) as double), 0) as total_spend,
        count(*) as contract_count from awards where {where}"""


def _largest(where: str, limit: int, columns: str = _SAMPLE) -> str:
    shown = _plain(columns.split(", "))
    ties = ", ".join(f"{c} nulls last" for c in columns.split(", ") if c != "contract_amount")
    return f"""with {_AWARDS} select {shown} from (
        select {columns} from awards where {where} order by contract_amount desc, {ties} limit {limit}) x"""


_NORTH = "(lower(agency) like '%customer#0000000%' or lower(agency) like '%customer#0000001%')"
_SOUTH = "lower(agency) like '%customer#0000004%'"


def _gate_sql() -> str:
    def row(name: str, category: str, expected: str, actual: str) -> str:
        return (
            f"select '{name}' as name, '{category}' as category, cast(({expected}) as bigint) as expected, "
            f"cast(({actual}) as bigint) as actual"
        )

    def bad(condition: str) -> str:
        return f"select count(*) from typed where {condition}"

    texts = ("agency", "notice_title", "item_name", "item_desc", "award_title", "awardee", "unspsc_code", "unspsc_desc")
    rows = [
        row("grain split keeps every row", "row conservation", "select count(*) from bronze",
            f"(select count(*) from raw) + (select count(*) from bronze where not ({_HAS_AWARD}))"
            .replace("not (contract_amount is not null and contract_amount != 'NULL')",
                     "contract_amount is null or contract_amount = 'NULL'")),
        row("typing keeps every row", "row conservation", "select count(*) from deduped",
            "(select count(*) from typed) + (select count(*) from zero)"),
        row("contract_amount positive", "types", "0", bad("contract_amount is null or contract_amount <= 0")),
        row("line_item_no positive", "types", "0", bad("line_item_no is null or line_item_no <= 0")),
        *[row(f"{c} plausible", "types", "0", bad(f"{c} is not null and year({c}) < 2000")) for c in _DATES],
        row("item_budget sentinel gone", "sentinels", "0", bad("item_budget = -1")),
        row("no literal NULL text", "sentinels", "0", bad(" or ".join(f"{c} = 'NULL'" for c in texts))),
        *[row(f"{c} blanks clean", "white space", "0", bad(f"{c} != trim({c}) or {c} like '%  %'"))
          for c in ("agency", "notice_title", "item_name", "awardee")],
        row("catalogue not empty", "catalogue", "1", "select cast(count(*) > 0 as integer) from items"),
        row("item_id distinct", "catalogue", "select count(*) from items", "select count(distinct item_id) from items"),
        row("embedding column present", "catalogue", "1", "1"),
    ]
    return f"""with {_TYPED}, {_items("typed", "items")},
checks as ({" union all ".join(rows)})"""


def _payload(source: str) -> str:
    def part(label: str, c: str) -> str:
        return f"case when trim({c}) not in ('', 'NULL') then '{label}: ' || trim({c}) end"

    return (
        "select item_id, coalesce(nullif(concat_ws(' | ', "
        f"{part('Title', 'notice_title')}, {part('Item', 'item_name')}, {part('Description', 'item_desc')}), ''), "
        f"'procurement item') as doc_text from {source}"
    )


def _templated() -> str:
    return """sampled as (
    select * from catalogue where item_name is not null and item_name != 'NULL'
    and item_id in (select item_id from vectors) order by md5(item_id), item_id limit 300
),
choices as (
    select *, list_filter(string_split_regex(trim(notice_title), '\\s+'), lambda w: w <> '') as title_words,
        list_filter(string_split_regex(trim(item_desc), '\\s+'), lambda w: w <> '') as desc_words from sampled
),
templated as (
    select unnest(list_filter([
        case when item_name <> '' then 'Procurement of ' || item_name end,
        case when item_name <> '' and unspsc_desc <> '' and not contains(lower(item_name), lower(unspsc_desc))
            then item_name || ' ' || unspsc_desc end,
        case when notice_title <> '' and lower(notice_title) <> lower(item_name) and len(title_words) > 3
            then array_to_string(title_words[1:6], ' ') end,
        case when item_desc <> '' and len(desc_words) > 3
            then trim(item_name || ' ' || item_desc[1:40]) end
    ], lambda q: q is not null)[1:2]) as question, item_id as target_item_id, item_name as target_item_name,
        coalesce(nullif(unspsc_desc, ''), 'Uncategorized') as category, 'templated' as source
    from choices
)"""


def _handwritten() -> str:
    values = ", ".join(f"('{q}', '{t}', '{c}')" for q, t, c in BENCHMARKS + TERMS)
    return f"""handwritten as (
    select question, target_item_id, target_item_name, category, 'hand-written' as source from (
        select question, category, item_id as target_item_id, item_name as target_item_name,
            row_number() over (partition by question order by item_id) as rn
        from (values {values}) b(question, term, category) join catalogue
        on contains(lower(item_name), lower(term)) or contains(lower(notice_title), lower(term)))
    where rn = 1
)"""


def _metrics_sql() -> str:
    every = " union all ".join(
        f"select '{s}' as strategy, t.query_id, (select min({r}) from {h} h where h.query_id = t.query_id "
        "and h.item_id = t.target_item_id) as rank from targets t"
        for s, h, r in (
            ("keyword", "keyword_hits", "rank"),
            ("vector", "vector_hits", "rank"),
            ("hybrid", "fused", "final_rank"),
        )
    )
    return f"""with {_PARTS}, {_templated()}, {_handwritten()},
targets as (
    select row_number() over (order by target_item_id, question) as query_id, question as query_text, target_item_id
    from (select question, target_item_id from templated union all select question, target_item_id from handwritten)
),
item_texts as ({_payload("catalogue")}),
{_dense("item_texts", "item_id", "doc_text", "item_vectors")},
{_dense("targets", "query_id", "query_text", "query_vectors")},
vector_hits as (
    select query_id, item_id, rank from (
        select query_id, item_id, row_number() over (partition by query_id order by score desc, item_id) as rank,
            score from (select q.query_id, i.item_id, round(list_cosine_similarity(q.vector, i.vector), 6) as score
            from query_vectors q cross join item_vectors i)) where rank <= 5
),
{_bm25("catalogue", "item_id", _ITEM_TEXT, "targets", 5, None, "keyword_hits")},
scored_hits as (select *, 0.0::double as score from vector_hits),
{_rrf(5, v="scored_hits")},
found as ({every})
select strategy, count(*) as questions, round(count(rank) / count(*), 6) as hit_rate,
    round(sum(coalesce(1.0::double / rank, 0)) / count(*), 6) as mrr
from found group by strategy"""


def _dense(source: str, key: str, text: str, out: str) -> str:
    """CTE ``out(key, vector)``: word counts hashed into 64 buckets, unit length, single precision."""
    return f"""{out} as (
    select {key}, list_transform(range(0, 64), lambda b: cast(coalesce(list_sum(list_transform(
        list_filter(parts, lambda p: p.bucket = b), lambda p: p.weight)), 0) as double)) as vector
    from (select {key}, list({{'bucket': bucket, 'weight': weight}}) as parts from (
        select {key}, bucket, cast(n / sqrt(sum(n * n) over (partition by {key})) as float) as weight from (
            select {key}, bucket, count(*) as n from (
                select {key}, ('0x' || substr(md5(word), 1, 8))::bigint % 64 as bucket from (
                    select {key}, unnest(list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'),
                        lambda w: w <> '')) as word from {source}))
            group by {key}, bucket)) group by {key})
)"""


def _hashed(source: str) -> str:
    return f"""with {_PARTS}, texts as ({_payload(source)}),
words as (
    select item_id, ('0x' || substr(md5(word), 1, 8))::bigint % 64 as bucket from (
        select item_id, unnest(list_filter(string_split_regex(lower(doc_text), '[^a-z0-9]+'),
            lambda w: w <> '')) as word from texts)
),
counted as (select item_id, bucket, count(*) as n from words group by item_id, bucket)
select item_id, bucket, round(cast(cast(n / sqrt(sum(n * n) over (partition by item_id)) as float) as double), 5)
    as weight from counted"""


_LOG = """log as (
    select event_id as id, ts as timestamp, event_type as query, value as latency_ms,
        case event_type when 'purchase' then 'thumbs_up' when 'error' then 'thumbs_down' end as feedback,
        k as prompt_tokens, k + cast(floor(value) as bigint) as total_tokens,
        (k * 0.075::double + cast(floor(value) as bigint) * 0.30::double) / 1000000.0::double as cost_usd
    from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)
)"""
_TIME = "strftime(timestamp, '%Y-%m-%d %H:%M:%S') as timestamp"


def _audit_sql() -> str:
    shapes = [
        "'SELECT \"Region\", COUNT(*) FROM gold.all_awards WHERE \"Award Reference No.\" = ' || ref || ' GROUP BY \"Region\"'",
        "'select * from gold.all_awards where quarter = ''2025-Q1'' limit ' || ref || ';'",
        "'DROP TABLE gold.t_' || ref",
        "'SELECT 1; DELETE FROM gold.all_awards WHERE 1=' || ref || ';'",
        "'with t as (select * from all_awards) select count(*) from t where \"Award Date\"  like ''1998%'' and 1<' || ref",
        "'SELECT REPLACE(Region, ''x'', ''' || ref || ''') FROM all_awards'",
        "'  UPDATE gold.all_awards SET Region = ''' || ref || '''  '",
        "'SELECT * FROM all_awards WHERE award date LIKE ''' || ref || '%'' LIMIT 5 ;'",
        "'INSERT INTO all_awards VALUES (''' || ref || ''')'",
        "'   ;'",
        "'SELECT COUNT(*)' || chr(10) || 'FROM all_awards' || chr(10) || 'WHERE \"Contract Amount\" >' || ref",
        "'SELECT java_method(''java.lang.System'', ''getProperty'', ''' || ref || ''') FROM all_awards'",
        "'SELECT COUNT(*) FROM parquet.`/lake/' || ref || '`'",
    ]
    picked = " ".join(f"when {i} then {s}" for i, s in enumerate(shapes))
    words = ", ".join(f"'{w}'" for w in FORBIDDEN_WORDS)
    engine = ", ".join(f"'{w}'" for w in ENGINE_WORDS)
    return f"""with statements as (
    select o_orderkey as log_id, case o_orderkey % {len(shapes)} {picked} end as sql
    from (select o_orderkey, cast(o_orderkey as varchar) as ref from orders)
),
cut as (select log_id, regexp_replace(trim(sql), ';+$', '') as text from statements),
split as (
    select *, list_filter(string_split_regex(upper(text), '[\\s(),]+'), lambda w: w <> '') as words from cut
),
judged as (
    select *, list_sort(list_distinct(list_filter(words, lambda w: w in ({words})))) as forbidden,
        list_sort(list_filter(string_split_regex(upper(text), '[^A-Z_0-9]+'), lambda w: w in ({engine}))) as engine,
        list_filter(list_transform(regexp_extract_all(text, '(?i)\\bFROM\\s+([^\\s(),;]+)', 1), lambda n: lower(replace(n, '`', ''))),
            lambda n: n not in ('all_awards', 'gold.all_awards')
                and not list_contains(regexp_extract_all(text, '(?i)\\bWITH\\s+(\\w+)\\s+AS', 1), n)) as foreigners from split
),
reasoned as (
    select *, case when contains(text, ';') then 'several statements'
        when len(words) = 0 then 'empty statement'
        when words[1] not in ('SELECT', 'WITH') then 'statement type ' || words[1]
        when len(forbidden) > 0 then 'forbidden word ' || array_to_string(forbidden, ', ')
        when len(engine) > 0 then 'forbidden word ' || array_to_string(engine, ', ')
        when len(foreigners) > 0 then 'foreign table ' || array_to_string(foreigners, ', ')
        else '' end as reason,
        regexp_replace(text, '("Award Date"|\\bAward Date\\b)\\s+LIKE', 'CAST("Award Date" AS STRING) LIKE', 'gi') as dated
    from judged
)
select log_id, reason, reason = '' as allowed, case when reason = '' then
    dated || case when list_contains(words, 'LIMIT') then '' else ' LIMIT 100' end end as safe_sql
from reasoned"""


def _summary_sql() -> str:
    def lines(column: str) -> str:
        return f"""(select string_agg('- ' || {column} || ': ₱' || format('{{:,.2f}}', spend) || ' ('
            || format('{{:,}}', award_count) || ' awards)', chr(10) order by position)
            from ({_top("hits", column, "query_id")}) x where x.query_id = l.query_id)"""

    return f"""{_discovery_ctes()},
sampled as (
    select * from (select *, row_number() over (partition by query_id order by {_SAMPLE_ORDER}) as position
        from sample_hits) where position <= 3
),
numbers as (
    select l.query_id, query_text, count(item_id) as n, cast(sum(contract_amount) as double) as total
    from lookups l left join hits on hits.query_id = l.query_id group by l.query_id, query_text
)
select query_id, case when n = 0 then 'No contracts match ''' || query_text || '''.' else
    'Spend for ''' || query_text || '''' || chr(10)
    || 'Total: ₱' || format('{{:,.2f}}', total) || ' over ' || format('{{:,}}', n) || ' contracts' || chr(10)
    || 'Mean: ₱' || format('{{:,.2f}}', total / n) || chr(10)
    || 'Top agencies:' || chr(10) || {lines("agency")} || chr(10)
    || 'Top regions:' || chr(10) || {lines("region")} || chr(10)
    || 'Largest contracts:' || chr(10) || (
        select string_agg('- ₱' || format('{{:,.2f}}', cast(contract_amount as double)) || ' | ' || item_name || ' | '
            || agency || ' | ' || awardee || ' | ' || cast(award_date as varchar) || ' | ' || award_ref,
            chr(10) order by position) from sampled s where s.query_id = l.query_id) end as summary
from numbers l"""


def _context_sql() -> str:
    return f"""with summaries as ({_summary_sql()}), listed as ({_discovery_ctes()}
    select query_id, string_agg(cast(rank as varchar) || '. ' || concat_ws(' | ', substr(item_id, 1, 8), item_name,
        notice_title, unspsc_desc, item_desc), chr(10) order by rank) as found
    from keyword_hits join catalogue using (item_id) where rank <= 5 group by query_id)
select query_id, concat_ws(chr(10), summary, 'Matched items:' || chr(10) || found) as context
from summaries left join listed using (query_id)"""


def oracle_sql() -> dict[str, str]:
    every = list(_VALUES)
    gate = _gate_sql()
    hybrid, discovery = _hybrid_ctes(), _discovery_ctes()
    ranked = "select query_id, item_id, score, rank from"
    doc_scope = "select doc_id from documents where lower(lang) like '%e%' and lower(source) like '%src1%'"
    bench = "(select item_id as query_id, text as query_text from benchmark)"
    awards_scope = _scope("asia", "customer#0000000")
    lists = f"""with {_PARTS},
{_bm25("catalogue", "item_id", _ITEM_TEXT, "label_queries", 100, None, "keyword_hits")}, {_cosine(100, None)}, {_rrf(10)}"""
    kpi_up = "count(*) filter (feedback like '%up%')"
    kpi_down = "count(*) filter (feedback like '%down%')"
    latest_feedback = f"""with {_LOG}, given as (
        select user_id, event_type, row_number() over (partition by user_id order by ts desc,
            case event_type when 'purchase' then 1 else 0 end desc) as rn
        from events where event_type in ('purchase', 'error'))
        select id, query, case event_type when 'purchase' then 'thumbs_up' when 'error' then 'thumbs_down' end
        as feedback from log left join given on id = user_id and rn = 1"""
    every_vector = f"""with corpus as (select vec_id, embedding::double[] as v from embeddings)
        select query_id, item_id, score, rank from (
            select *, row_number() over (partition by query_id order by score desc, item_id) as rank from (
                select q.vec_id as query_id, c.vec_id as item_id, round(list_cosine_similarity(q.v, c.v), 6) as score
                from corpus q cross join corpus c)) where rank <= 5"""
    return {
        "bronze_all_string": f"with {_BRONZE} select * from bronze",
        "grain_split_counts": f"""with {_BRONZE} select count(*) filter ({_HAS_AWARD}) as awards,
            count(*) filter (contract_amount is null or contract_amount = 'NULL') as quarantine,
            count(*) as original from bronze""",
        "awards_raw": f"with {_DEDUPED} select * from raw",
        "quarantine_no_award": f"""with {_BRONZE} select * from bronze
            where contract_amount is null or contract_amount = 'NULL'""",
        "awards_deduped": f"with {_DEDUPED} select * from deduped",
        "awards_typed": f"with {_TYPED} select {_plain(every)} from typed",
        "awards_zero_amount": f"with {_TYPED} select * from zero",
        "quality_gate": f"{gate} select *, expected = actual as passed from checks",
        "quality_gate_summary": f"""{gate} select count(*) filter (expected = actual) as passed, count(*) as total,
            coalesce(string_agg(case when expected <> actual then name end, ', ' order by name), '') as failed
            from checks""",
        "quarter_tables": f"""with {_AWARDS} select quarter, 'y' || replace(lower(quarter), '-', '_') as prefix,
            count(*) as awards from awards group by quarter""",
        "reload_quarter": f"""with {_BRONZE}, kinds as (select quarter, case when contract_amount is null
            or contract_amount = 'NULL' then 'quarantine_no_award' else 'awards_raw' end as table_name from bronze)
            select quarter, table_name, count(*) as rows from kinds
            where not (quarter = '1995-Q1' and table_name = 'quarantine_no_award') group by all""",
        "quarters_union": f"""with {_BRONZE} select award_ref, region,
            case when quarter >= '1995-Q1' then awardee end as awardee, quarter from bronze""",
        "unique_items": f"with {_TYPED}, {_items('typed', 'items')} select * from items",
        "unique_items_increment": f"""with {_AWARDS}, {_items('awards', 'items')}
            select * from items where item_id not in (
                select item_id from awards where quarter = (select min(quarter) from awards))""",
        "keyless_awards": f"""with {_TYPED} select count(*) as awards, count(*) filter (
            notice_title is null or item_name is null or item_desc is null) as without_item_id from typed""",
        "all_awards_consolidated": f"""with {_TYPED} select
            md5(lower(notice_title || item_name || item_desc)) as item_id, {_plain(every)} from typed""",
        "largest_award_per_item": f"""with {_AWARDS} select item_id, agency, region, awardee, award_ref,
            cast(contract_amount as double) as contract_amount from (
            select *, row_number() over (partition by item_id
                order by contract_amount desc, award_ref, agency, awardee, region) as rn from awards) where rn = 1""",
        "spend_summary": f"with {_AWARDS}, {_PARTS}, {_RINGS} select {_TOTALS} from rings",
        "top_agencies": f"with {_AWARDS}, {_PARTS}, {_RINGS} {_top('rings', 'agency')}",
        "top_regions": f"with {_AWARDS}, {_PARTS}, {_RINGS} {_top('rings', 'region')}",
        "sample_awards": f"""with {_AWARDS}, {_PARTS}, {_RINGS} select {_SAMPLE_PLAIN} from (
            select {_SAMPLE} from rings order by {_SAMPLE_ORDER} limit 5) x""",
        "profile_by_dimension": _shape("procurement_mode", limit=20, average=True),
        "leaderboard": _shape("awardee", limit=10),
        "point_aggregate": _point("lower(region) like '%america%' and quantity > 25"),
        "compare_modes": _shape("org_group", "org_group in ('BUILDING', 'MACHINERY')"),
        "budget_savings": _savings(),
        "spend_totals": f"""with {_AWARDS} select cast(sum(contract_amount) as double) as total_spend,
            count(*) as award_count,
            cast(round(cast(sum(contract_amount) as decimal(38,10)) / count(*), 6) as double) as avg_spend from awards""",
        "spend_in_period": _point("award_date between date '1997-02-01' and date '1999-10-31'"),
        "answer_totals": f"""with {_BRONZE}, money as (
            select coalesce(try_cast(contract_amount as double), try_cast(approved_budget as double)) as m from bronze)
            select round(sum(m), 2) as total_spend, count(*) as award_count,
            round(sum(m) / count(*), 4) as avg_spend from money""",
        "adhoc_sql": f"""with {_AWARDS} select region as "Region", awardee_size as "Awardee Size",
            count(*) as contracts, cast(sum(contract_amount) as double) as total_spend from awards
            where approved_budget > contract_amount and award_date between date '1996-01-01' and date '1999-12-31'
            and quantity >= 10 group by all""",
        "q01_top_supplier": _shape("awardee", f"{_NORTH} and year(award_date) = 1998", 1),
        "q02_agency_quarter_spend": _point(f"{_SOUTH} and quarter = '1997-Q1'"),
        "q03_largest_in_region": _largest("lower(region) like '%europe%'", 1),
        "q04_compare_classifications": _shape("classification", "classification in ('LARGE', 'PROMO')"),
        "q05_compare_modes": _shape("procurement_mode", "procurement_mode in ('1-URGENT', '5-LOW')"),
        "q06_small_firm_contracts": _largest(
            "awardee_size in ('Micro', 'Small')", 5,
            "award_ref, awardee, awardee_size, agency, contract_amount, award_date",
        ),
        "q07_budget_savings": _savings(),
        "q08_supplier_contracts": _point("lower(awardee) like '%supplier#000000007%'"),
        "q09_catalogue_items": f"""{discovery} select query_id, item_id, rank as final_rank, score,
            'keyword' as source from keyword_hits where rank <= 5""",
        "q09_catalogue_spend": f"""{discovery} select l.query_id,
            coalesce(cast(sum(contract_amount) as double), 0) as total_spend, count(item_id) as award_count,
            round(case when count(item_id) > 0 then cast(sum(contract_amount) as double) / count(item_id) else 0 end, 4)
            as avg_spend from lookups l left join hits on hits.query_id = l.query_id group by l.query_id""",
        "q10_city_spend": _point("lower(city) like '%nation_7 city%'"),
        "q11_agency_spend": _point(_NORTH),
        "q12_no_match": _point("lower(notice_title) like '%nuclear submarine%'"),
        "q13_agency_profile": _shape("classification", _SOUTH, 20, average=True),
        "q14_branch_spend": _shape("government_branch", "government_branch is not null", 10),
        "q15_largest_on_topic": _largest(f"lower(notice_title) like '%gear%' and {_NORTH}", 5),
        "q16_topic_spend": _point("lower(notice_title) like '%widget%' or lower(item_name) like '%widget%'"),
        "q17_largest_by_organisation": _largest(
            "org_group = 'HOUSEHOLD' and classification in ('LARGE', 'STANDARD')", 5
        ),
        "q18_topic_suppliers": _shape("awardee", f"{_SOUTH} and lower(notice_title) like '%plate%'", 10),
        "inverted_index": f"""with {_bm25("documents", "doc_id", "text", bench, 20, None, "hits")}
            select term, item_id, tf, doc_len from postings""",
        "index_terms": f"""with {_bm25("documents", "doc_id", "text", bench, 20, None, "hits")}
            select term, df from terms""",
        "bm25_topk": f"with {_bm25('documents', 'doc_id', 'text', bench, 20, None, 'hits')} {ranked} hits",
        "bm25_topk_scoped": f"with {_bm25('documents', 'doc_id', 'text', bench, 20, doc_scope, 'hits')} {ranked} hits",
        "name_matches": f"""with {_PARTS}, asked as (select distinct lower(p_name) as term from part)
            select term, min(item_id) as item_id, count(*) as matches from asked join catalogue on
                contains(lower(notice_title), term) or contains(lower(item_name), term) or contains(lower(item_desc), term)
            group by term""",
        "distinct_sketches": f"""with {_AWARDS} select substr(quarter, 1, 4) as year,
            count(distinct item_id) as exact, true as within from awards group by 1""",
        "cosine_all": every_vector,
        "ann_stored": every_vector,
        "cosine_topk": f"with {_PARTS}, {_cosine(20, None)} {ranked} vector_hits",
        "cosine_topk_scoped": f"with {_AWARDS}, {_PARTS}, {_cosine(20, awards_scope)} {ranked} vector_hits",
        "ann_all_cells": f"with {_PARTS}, {_cosine(20, None)} {ranked} vector_hits",
        "rrf_fusion": f"{lists} select * from fused",
        "hybrid_search": f"{hybrid} select * from fused join catalogue using (item_id)",
        "hybrid_spend": f"{hybrid} select query_id, {_TOTALS} from hits group by query_id",
        "hybrid_top_agencies": f"{hybrid} {_top('hits', 'agency', 'query_id')}",
        "hybrid_samples": f"""{hybrid} select query_id, position, {_SAMPLE_PLAIN} from (
            select f.query_id, scoped.*, row_number() over (partition by f.query_id order by {_SAMPLE_ORDER})
            as position from fused f join scoped using (item_id)) where position <= 5""",
        "spend_answer_text": _summary_sql(),
        "spend_answer_context": _context_sql(),
        "ground_truth_queries": f"""with {_PARTS}, {_templated()}, {_handwritten()}
            select * from templated union all select question, target_item_id, target_item_name, category, source
            from handwritten""",
        "ground_truth_json": f"""with {_PARTS}, {_templated()}, {_handwritten()}
            select * from templated union all select question, target_item_id, target_item_name, category, source
            from handwritten""",
        "enriched_sample": f"""with {_AWARDS}, {_PARTS}, best as (
            select * from (select *, row_number() over (partition by item_id
                order by contract_amount desc, award_ref, agency, awardee, region) as rn from awards) where rn = 1),
            drawn as (select c.item_id, c.notice_title, c.item_name, c.item_desc, c.unspsc_desc as category,
                agency, region, awardee, cast(contract_amount as double) as amount
                from catalogue c join best using (item_id) where len(c.item_name) > 3
                and c.item_id in (select item_id from vectors)),
            missing as (select greatest(0, 50 - count(distinct target_item_id)) as n from label_queries),
            lots as (select *, row_number() over (order by md5(item_id), item_id) as lot from drawn),
            kept as (select *, row_number() over (order by lot) as place from lots
                where lot <= 3 * (select n from missing) and item_id not in (select target_item_id from label_queries))
            select * exclude (lot, place) from kept where place <= (select n from missing)""",
        "retrieval_metrics": _metrics_sql(),
        "answer_scorecard": _scorecard(),
        "results_json": _scorecard(),
        "display_rows": f"""with {_AWARDS} select award_ref, coalesce(awardee_size, '') as awardee_size,
            cast(award_date as varchar) as award_date, cast(contract_amount as varchar) as contract_amount,
            cast(quantity as double) as quantity from awards""",
        "pending_embeddings": f"""with {_PARTS} select item_id from catalogue
            where item_id not in (select item_id from vectors)""",
        "next_chunk": f"""with {_PARTS} select item_id from catalogue
            where item_id not in (select item_id from vectors) order by item_id limit 500""",
        "embed_rebuild": _hashed("catalogue"),
        "embed_parts": _hashed("catalogue"),
        "doc_text": f"with {_TYPED}, {_items('typed', 'items')} {_payload('items')}",
        "embedding_cost": f"""with {_PARTS}, pending as (
            select * from catalogue where item_id not in (select item_id from vectors)),
            texts as ({_payload("pending")}),
            chunks as (select (rn - 1) // 500 + 1 as chunk, count(*) as items, cast(sum(len(doc_text)) // 4 as bigint) as tokens
                from (select *, row_number() over (order by item_id) as rn from texts) group by 1),
            summed as (select *, sum(items) over (order by chunk) as i, sum(tokens) over (order by chunk) as t from chunks)
            select chunk, items, tokens, round(tokens / 1000000.0::double * 0.025::double, 10) as cost_usd,
            cast(i as bigint) as total_items, cast(t as bigint) as total_tokens,
            round(t / 1000000.0::double * 0.025::double, 10) as total_cost_usd,
            round(t / 1000000.0::double * 0.025::double * 56.0::double, 8) as total_cost_php from summed""",
        "item_embeddings": _hashed("catalogue"),
        "telemetry_kpis": f"""with {_LOG} select count(*) as total_queries, round(avg(latency_ms), 4) as avg_latency_ms,
            cast(sum(total_tokens) as bigint) as total_tokens, round(sum(cost_usd), 6) as total_cost_usd,
            {kpi_up} as thumbs_up, {kpi_down} as thumbs_down,
            round({kpi_up} / ({kpi_up} + {kpi_down}) * 100.0::double, 4) as satisfaction_rate from log""",
        "telemetry_feedback": f"""with {_LOG} select 'helpful' as status, {kpi_up} as queries from log
            union all select 'poor', {kpi_down} from log
            union all select 'unrated', count(*) - count(feedback) from log""",
        "telemetry_feedback_latest": latest_feedback,
        "ratings_stream": latest_feedback,
        "telemetry_recent": f"""with {_LOG} select id, {_TIME}, query, round(latency_ms, 0) as latency_ms,
            prompt_tokens, total_tokens, cost_usd, coalesce(feedback, 'None') as feedback from log
            order by id desc limit 150""",
        "telemetry_latest": f"""with {_LOG} select id, {_TIME}, query, prompt_tokens, total_tokens, cost_usd,
            latency_ms, feedback from log order by id desc limit 10""",
        "telemetry_latency": f"with {_LOG} select id, latency_ms from log",
        "telemetry_cost": f"""with {_LOG} select query, count(*) as calls,
            cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(total_tokens) as bigint) as total_tokens,
            round((sum(prompt_tokens) * 0.075::double + (sum(total_tokens) - sum(prompt_tokens)) * 0.30::double)
                / 1000000.0::double, 8) as cost_usd from log group by query""",
        "append_log": f"with {_LOG} select id, query, latency_ms from log",
        "log_evolution": f"""with {_LOG} select id, query, case when query <> 'click' then feedback end as feedback,
            case when query = 'click' then 0 else prompt_tokens end as prompt_tokens,
            case when query = 'click' then 0 else total_tokens end as total_tokens from log""",
        "query_audit": _audit_sql(),
        "embed_stream": _hashed("catalogue"),
        "catalog_stream": f"with {_AWARDS}, {_items('awards', 'items')} select * from items",
        "telemetry_stream": f"""with {_LOG} select
            strftime(date_trunc('day', timestamp), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as queries,
            round(cast(sum(cast(latency_ms as decimal(18,4))) as double) / count(*), 4) as avg_latency_ms,
            {kpi_up} as thumbs_up, {kpi_down} as thumbs_down from log group by 1""",
    }


def _savings() -> str:
    return f"""with {_AWARDS} select cast(sum(approved_budget - contract_amount) as double) as total_savings,
        count(*) as contract_count from awards where approved_budget > contract_amount"""


def _scorecard() -> str:
    rows = " union all ".join(
        f"select '{name}' as dimension, count(*) as questions, round(avg({name}), 2) as mean_score, "
        f"{target}::double as target, round(avg({name}), 2) >= {target} as passed from scored"
        for name, target in (("faithfulness", 4.5), ("relevance", 4.5), ("completeness", 4.0), ("overall", 4.5))
    )
    return f"""with scores as (
        select 1 + 4 * quality as faithfulness, 5 - 4 * toxic as relevance, 1 + n_chars % 5 as completeness
        from labels join documents using (doc_id)),
    scored as (select *, (faithfulness + relevance + completeness) / 3.0::double as overall from scores)
    {rows}"""
