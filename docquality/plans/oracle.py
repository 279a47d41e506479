"""The queries as SQL for DuckDB, written relationally and apart from the expressions that the queries use."""

from __future__ import annotations

from . import rules as R

_FOLD = "upper(strip_accents(replace(translate({}, 'ªº', 'ao'), 'ß', 'ss')))"


def norm(x: str) -> str:
    return f"trim(regexp_replace({_FOLD.format(x)}, '\\s+', ' ', 'g'))"


def compact(x: str) -> str:
    return f"regexp_replace({norm(x)}, '[^A-Z0-9]', '', 'g')"


def noise(x: str) -> str:
    return f"translate({x}, 'OoIlSB', '001158')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, '|', ' '), '\\s+', ' ', 'g'), ' :;,-' || chr(9))"


CPF, DATE, RG, LONG_DIGITS, SITE = r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b\d{1,2}\.?\d{3}\.?\d{3}-?[\dXx]?\b", r"\b\d{8,12}\b", r"\b(?:WWW\.)?[A-Z0-9.-]+\.(?:COM|BR)(?:\.[A-Z]{2})?\b"
LABELS = "NOME|CPF|NASCIMENTO|FILIACAO|VALIDADE|REGISTRO|EXPEDICAO|NATURALIDADE|DOC|ORGAO|ASSINATURA|TERRITORIO|MINISTERIO|SECRETARIA|REPUBLICA|CARTEIRA"
CPF_FIELD = "field_name in ('cpf', 'numero_cpf')"
DATE_FIELD = "(contains(field_name, 'data') or field_name in ('validade', 'primeira_habilitacao'))"


def is_label(n: str) -> str:
    return f"(regexp_matches({n}, '{LABELS}') and len(string_split(trim({n}), ' ')) <= 5)"


def first(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', 0), '')"


def dotted(x: str) -> str:
    d = digits(x)
    return f"case when length({d}) = 11 then regexp_replace({d}, '^(.{{3}})(.{{3}})(.{{3}})(.{{2}})$', '\\1.\\2.\\3-\\4') else trim({x}) end"


def year(y: str) -> str:
    return f"case when {y} <= 30 then 2000 + {y} when {y} < 100 then 1900 + {y} else {y} end"


def date_parts(x: str) -> str:
    return f"list_transform(string_split_regex({first(noise(x), DATE)}, '[/-]'), lambda p: p::int)"


def parsed(x: str) -> str:
    p = date_parts(x)
    return f"try_cast(printf('%04d-%02d-%02d', {year(f'({p})[3]')}, ({p})[2], ({p})[1]) as date)"


def standard(x: str) -> str:
    p = date_parts(x)
    return f"coalesce(printf('%02d/%02d/%04d', ({p})[1], ({p})[2], {year(f'({p})[3]')}), {x})"


def plausible(x: str, name: str, as_of: str) -> str:
    d = parsed(x)
    return f"coalesce(year({d}) between 1900 and year(date '{as_of}') + 20 and not (contains({name}, 'nascimento') and {d} > date '{as_of}'), false)"


def checksum(x: str) -> str:
    d = digits(x)
    total = lambda n: f"list_sum(list_transform(range(1, {n + 1}), lambda i: substr({d}, i, 1)::int * ({n + 2} - i))) * 10 % 11 % 10"
    same = " and ".join(f"substr({d}, {i}, 1) = substr({d}, 1, 1)" for i in range(2, 12))
    return f"(case when length({d}) <> 11 then false else not ({same}) and {total(9)} = substr({d}, 10, 1)::int and {total(10)} = substr({d}, 11, 1)::int end)"


def similar(a: str, b: str) -> str:
    return f"(case when greatest(length({a}), length({b})) = 0 then 1.0 when {a} = {b} then 1.0 else greatest(0.0, 1 - levenshtein({a}, {b})::double / greatest(length({a}), length({b}))) end)::double"


def pick(names: tuple[str, ...], n: str) -> str:
    return f"({list(names)!r})[1 + (({n}) % {len(names)})::int]"


def _cards() -> str:
    from ..sources import id_cards as C

    digit = lambda i: f"substr(nine, {i + 1}, 1)::int"
    one = " + ".join(f"{digit(i)} * {10 - i}" for i in range(9))
    two = " + ".join(f"{digit(i)} * {11 - i}" for i in range(9))
    lines = []
    for t, layout in C.LAYOUT.items():
        row = ", ".join("'" + x.replace("{", "' || ").replace("}", " || '") + "'" if "{" in x else f"'{x}'" for x in layout)
        lines.append(f"when '{t}' then [{row}]")
    return f"""
numbered as (
    select c_custkey::bigint as k, n_name as city, coalesce((select min(o_orderdate)::date from orders where o_custkey = c_custkey), date '1990-01-01') as day0,
        lpad(((c_custkey::bigint * 102947 + 123456789) % 1000000000)::varchar, 9, '0') as nine
    from customer join nation on c_nationkey = n_nationkey
), checked as (select *, ({one}) * 10 % 11 % 10 as one from numbered
), checked2 as (select *, ({two} + 2 * one) * 10 % 11 % 10 as two from checked
), cards as (
    select k as doc_id, {pick(R.TYPES, 'k')} as document_type, city,
        substr(nine, 1, 3) || '.' || substr(nine, 4, 3) || '.' || substr(nine, 7, 3) || '-' || one || case when k % 7 = 0 then (two + 1) % 10 else two end as cpf,
        {pick(C.FIRST, 'k')} || ' ' || {pick(C.LAST, 'k // 7')} as name, 'Pedro ' || {pick(C.LAST, 'k // 3')} as father, {pick(C.FIRST, 'k + 2')} || ' ' || {pick(C.LAST, 'k // 5')} as mother,
        strftime(date '1950-01-01' + (k * 37 % 18000)::int, '%d/%m/%Y') as born, strftime(day0, '%d/%m/%Y') as issued, strftime(day0 + 3650, '%d/%m/%Y') as valid,
        lpad((k * 7907 % 100000000)::varchar, 9, '0') as rg, lpad((k * 104729 % 10000000000)::varchar, 11, '0') as number
    from checked2
), layout as (select doc_id, document_type, case document_type {' '.join(lines)} end as lines from cards
), gt_raw as (select doc_id, document_type, unnest(range(len(lines))) as i, unnest(lines) as text, 100.0::double as confidence from layout
), ocr_raw as (
    select doc_id, document_type, i, case (doc_id * 31 + i * 17) % 23 when 0 then '' when 1 then translate(text, '01', 'OI') when 2 then lower(text) when 3 then text || ' |'
        when 4 then left(text, length(text) - 1) else text end as text, (40 + (doc_id * 31 + i * 17) % 60)::double as confidence
    from gt_raw
)"""


def _lines(s: str) -> str:
    """CTEs <s>_l (lines in normal form) and <s>_t (texts) from <s>_raw."""
    return f"""
{s}_n as materialized (
    select doc_id, document_type, (row_number() over (partition by doc_id order by i) - 1)::int as idx, text, confidence, {norm('text')} as norm, {digits('text')} as digits from {s}_raw where trim(text) <> ''
), {s}_l as materialized (
    select *, regexp_replace(norm, '[^A-Z0-9]', '', 'g') as small, {is_label('norm')} as is_label, case when not {is_label('norm')} then nullif({clean('text')}, '') end as value from {s}_n
), {s}_t as materialized (
    select doc_id, document_type, string_agg(text, chr(10) order by idx) as full_text, {noise("string_agg(text, chr(10) order by idx)")} as noise_text, avg(confidence) as mean_confidence,
        count(*) as n_lines, sum(len(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' '))) as n_words, list({{'idx': idx, 'norm': norm, 'small': small, 'digits': digits, 'confidence': confidence}} order by idx) as lines
    from {s}_l group by doc_id, document_type
)"""


def _rules(methods: tuple[str, ...]) -> str:
    out = []
    for t, rules in R.RULES.items():
        for r in rules:
            if r.method in methods:
                a, b = (*r.labels, None)[:2] if r.labels else (None, None)
                out.append(f"('{t}', '{r.field}', " + ", ".join("null" if x is None else f"'{x}'" for x in (a, b)) + f", '{r.method}', '{r.pattern}')")
    return ", ".join(out)


def _fields(s: str) -> str:
    """CTE <s>_f: the extracted fields."""
    step = lambda x, label: f"case when {label} is null then {x} else trim(regexp_replace(regexp_replace({x}, {label}, '', 'gi'), '\\s+', ' ', 'g')) end"
    patterns = {"RG": RG, "LONG_DIGITS": LONG_DIGITS, "SITE": SITE}
    by_pattern = " ".join(f"when '{k}' then {first('noise_text', v)}" for k, v in patterns.items())
    stop = "|".join(R.STOP_MARKERS)
    return f"""
{s}_rules as (select * from (values {_rules(('value', 'date'))}) as r(document_type, field_name, a, b, method, pattern)
), {s}_at as materialized (
    select l.doc_id, l.document_type, r.field_name, r.a, r.b, l.idx, l.norm from {s}_l l join {s}_rules r on l.document_type = r.document_type and (contains(l.norm, r.a) or coalesce(contains(l.norm, r.b), false))
), {s}_in as (select *, {step('norm', 'a')} as one from {s}_at
), {s}_inl as (select *, nullif({clean(step('one', 'b'))}, '') as rest from {s}_in
), {s}_c as (
    select doc_id, field_name, idx, 0 as prio, rest as value from {s}_inl where rest is not null and not {is_label(norm('rest'))}
    union all
    select t.doc_id, t.field_name, t.idx, case when v.idx > t.idx then v.idx - t.idx else 4 + t.idx - v.idx end, v.value
    from {s}_at t join {s}_l v on v.doc_id = t.doc_id and v.idx between t.idx - 4 and t.idx + 4 and v.idx <> t.idx where v.value is not null
), {s}_v as materialized (select doc_id, field_name, arg_min(value, idx * 100 + prio) as value from {s}_c group by doc_id, field_name
), {s}_w as (
    select t.doc_id, t.field_name, t.idx, {first(noise("string_agg(v.text, ' ' order by v.idx)"), DATE)} as found
    from {s}_at t join {s}_l v on v.doc_id = t.doc_id and v.idx between t.idx - 3 and t.idx + 4 group by t.doc_id, t.field_name, t.idx
), {s}_wd as (select doc_id, field_name, arg_min(found, idx) as found from {s}_w where found is not null group by doc_id, field_name
), {s}_near as (
    select r.method, d.doc_id, d.document_type, r.field_name, r.pattern, v.value as near_value, w.found from {s}_t d join {s}_rules r using (document_type) left join {s}_v v on v.doc_id = d.doc_id and v.field_name = r.field_name
    left join {s}_wd w on w.doc_id = d.doc_id and w.field_name = r.field_name
), {s}_follow as (
    select a.doc_id, a.idx as label_at, b.idx, b.value, max(case when regexp_matches(b.norm, '{stop}') then 1 else 0 end) over (partition by a.doc_id, a.idx order by b.idx) as stopped
    from {s}_l a join {s}_l b on a.doc_id = b.doc_id and b.idx between a.idx + 1 and a.idx + 5 where contains(a.norm, 'FILIACAO')
), {s}_names as (
    select doc_id, (list(value order by label_at, idx))[1:2] as names from {s}_follow where stopped = 0 and value is not null and not regexp_matches(value, '{DATE}') group by doc_id
), {s}_f as materialized (
    select * from (
        select doc_id, document_type, field_name, case method when 'date' then case when near_value is not null then {first(noise('near_value'), DATE)} else found end else coalesce(near_value, case when pattern = 'RG' then (select {first(noise('t.noise_text'), RG)} from {s}_t t where t.doc_id = {s}_near.doc_id) end) end as value, null::varchar[] as names from {s}_near
        union all
        select doc_id, document_type, r.field_name, case r.method when 'cpf' then (select {dotted('x')} from (select {first(noise('noise_text'), CPF)} as x)) else case r.pattern {by_pattern} end end, null::varchar[]
        from {s}_t join (values {_rules(('cpf', 'pattern'))}) as r(document_type, field_name, a, b, method, pattern) using (document_type)
        union all
        select d.doc_id, d.document_type, 'filiacao', null, coalesce(n.names, []) from {s}_t d left join {s}_names n using (doc_id) where d.document_type in ('CNH_Frente', 'RG_Verso')
    ) where names is not null or trim(value) <> ''
)"""


def _signals(s: str, as_of: str) -> str:
    """CTE <s>_s: signals and scores of the fields."""
    audit = ", ".join(f"('{t}', '{f}', {list(labels)!r})" for t, fields in R.AUDIT_LABELS.items() for f, labels in fields.items())
    minimum = ", ".join(f"('{t}', {i}, '{f}')" for t, fields in R.MINIMUM.items() for i, f in enumerate(fields))
    by_kind = lambda use: f"case when {CPF_FIELD} then {use(CPF)} when {DATE_FIELD} then {use(DATE)} when field_name = 'registro_geral' then {use(RG)} when field_name = 'numero_registro' then {use(LONG_DIGITS)} when field_name = 'site' then {use(SITE)} end"
    full = by_kind(lambda p: f"regexp_full_match(case when {CPF_FIELD} then {dotted('shown')} else shown end, '{p}')")
    counted = by_kind(lambda p: f"len(list_distinct(list_filter(list_transform(regexp_extract_all(noise_text, '{p}'), lambda x: {compact('x')}), lambda x: x <> '')))")
    valid = f"""case when names is not null then len(names) > 0 and len(list_filter(names, lambda x: length({compact('x')}) < 2)) = 0
        when {CPF_FIELD} then length({digits('value')}) = 11 when {DATE_FIELD} then {plausible('value', 'field_name', as_of)} when field_name = 'registro_geral' then length({compact('value')}) between 5 and 14
        when field_name = 'numero_registro' then length({digits('value')}) between 8 and 12 when field_name = 'site' then regexp_full_match({norm('value')}, '{SITE}') else length({compact('value')}) >= 2 end"""
    bit = lambda c, applies="true": f"case when {c} then 1.0 when {applies} then 0.0 end"
    values = {
        "field_extracted": "1.0", "came_after_expected_label": bit("came_after_expected_label", "expected_label_found"),
        "distance_to_label": "case when distance_to_label is null then null when distance_to_label = 0 then 1.0 else greatest(0.0, 1 - (abs(distance_to_label) - 1) / 4.0) end",
        "regex_full_match": bit("regex_full_match", "regex_full_match is not null"), "format_valid": bit("format_valid"), "no_candidate_conflict": bit("not conflict_with_other_candidates"),
        "minimum_expected_field_found": bit("minimum_expected_field", "false"), "cpf_has_11_digits": bit("cpf_has_11_digits", "cpf_has_11_digits is not null"),
        "cpf_check_digits_valid": bit("cpf_check_digits_valid", "cpf_check_digits_valid is not null"), "date_plausible": bit("date_plausible", "date_plausible is not null"),
    }
    listed = ", ".join(f"{{'w': {R.WEIGHTS[k]}::double, 'v': ({v})::double}}" for k, v in values.items())
    hit = "(n <> '' and contains(x.norm, n)) or {} (d <> '' and contains(x.digits, d))"
    return f"""
{s}_audit as (select * from (values {audit}) as a(document_type, field_name, labels)
), minimum as (select * from (values {minimum}) as m(document_type, ordinal, field_name)
), {s}_x as (
    select f.*, t.noise_text, t.lines, coalesce(a.labels, []) as labels, coalesce(array_to_string(f.names, ' '), f.value) as lookup, trim({noise('f.value')}) as shown, m.field_name is not null as minimum_expected_field
    from {s}_f f join {s}_t t using (doc_id) left join {s}_audit a on a.document_type = f.document_type and a.field_name = f.field_name left join minimum m on m.document_type = f.document_type and m.field_name = f.field_name
), {s}_y as (
    select *, {norm('lookup')} as n, {compact('lookup')} as c, {digits('lookup')} as d, list_filter(lines, lambda x: len(list_filter(labels, lambda k: contains(x.norm, k))) > 0)[1].idx as label_idx from {s}_x
), {s}_z as (
    select *, list_filter(lines, lambda x: {hit.format("(c <> '' and contains(x.small, c)) or")})[1].idx as value_idx,
        case when names is null then list_filter(lines, lambda x: {hit.format('')})[1].confidence
            else list_avg(list_filter(list_transform(names, lambda v: list_filter(lines, lambda x: contains(x.norm, {norm('v')}) or ({digits('v')} <> '' and contains(x.digits, {digits('v')})))[1].confidence), lambda q: q is not null)) end as ocr_confidence
    from {s}_y
), {s}_near_count as (
    select z.doc_id, z.field_name, count(*) as near_count from {s}_z z join {s}_l l on l.doc_id = z.doc_id and l.idx between z.label_idx - 4 and z.label_idx + 4 and l.idx <> z.label_idx where l.value is not null group by z.doc_id, z.field_name
), {s}_q as (
    select z.*, label_idx is not null as expected_label_found, value_idx - label_idx as distance_to_label, coalesce(value_idx - label_idx >= 0, false) as came_after_expected_label, {full} as regex_full_match, {valid} as format_valid,
        coalesce({counted}, near_count, 0)::int as candidate_count, minimum_expected_field as minimum_expected_field_found, case when {CPF_FIELD} then length(d) = 11 end as cpf_has_11_digits, case when {CPF_FIELD} then {checksum('lookup')} end as cpf_check_digits_valid,
        case when {DATE_FIELD} then {plausible('lookup', 'field_name', as_of)} end as date_plausible
    from {s}_z z left join {s}_near_count using (doc_id, field_name)
), {s}_p as (select *, candidate_count > 1 as conflict_with_other_candidates from {s}_q
), {s}_r as (select *, list_filter([{listed}], lambda x: x.v is not null) as parts from {s}_p
), {s}_s as materialized (
    select *, round_even(list_sum(list_transform(parts, lambda x: round_even(x.w * x.v / list_sum(list_transform(parts, lambda y: y.w)) * 100, 2))), 2) as parsing_confidence, len(parts)::int as n_components from {s}_r
)"""


def _comparisons() -> str:
    shown = "coalesce(array_to_string(names, ' | '), value, '')"
    normal = lambda c: compact(f"case when {CPF_FIELD} then case when length({digits(c)}) = 11 then {digits(c)} else {c} end when {DATE_FIELD} then {standard(c)} else {c} end")
    sig = "regex_full_match, format_valid, cpf_has_11_digits, cpf_check_digits_valid, date_plausible, minimum_expected_field_found, conflict_with_other_candidates, distance_to_label"
    return f"""
all_names as (
    select doc_id, m.field_name from ocr_t join minimum m using (document_type) union select doc_id, field_name from ocr_f union select doc_id, field_name from gt_f
), paired as (
    select a.doc_id, t.document_type, a.field_name, coalesce((select {shown} from (select s.names, s.value)), '') as predicted_value, coalesce((select {shown} from (select g.names, g.value)), '') as ground_truth_value, ocr_confidence, parsing_confidence, {sig}
    from all_names a join ocr_t t using (doc_id) left join ocr_s s on s.doc_id = a.doc_id and s.field_name = a.field_name left join gt_f g on g.doc_id = a.doc_id and g.field_name = a.field_name
), normed as materialized (select *, {normal(norm_ws('predicted_value'))} as p, {normal(norm_ws('ground_truth_value'))} as t from paired
), field_cmp as materialized (
    select *, predicted_value <> '' as field_found, ground_truth_value <> '' as ground_truth_available, t <> '' and p = t as exact_match, t <> '' and {similar('p', 't')} >= 0.8 as accepted_match,
        round_even({similar('p', 't')}, 4) as similarity, levenshtein(p, t)::int as levenshtein_distance
    from normed
), texts as (
    select o.doc_id, o.document_type, o.full_text as predicted_value, coalesce(g.full_text, '') as ground_truth_value, {compact('o.full_text')} as p, coalesce({compact('g.full_text')}, '') as t, o.mean_confidence
    from ocr_t o left join gt_t g using (doc_id)
), text_cmp as materialized (
    select *, p = t and ground_truth_value <> '' as exact_match, ground_truth_value <> '' and t <> '' and {similar('p', 't')} >= 0.8 as accepted_match, round_even({similar('p', 't')}, 4) as similarity, levenshtein(p, t)::int as levenshtein_distance from texts
)"""


def norm_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _documents() -> str:
    ok = "f.ground_truth_available"
    return f"""
doc_fields as (
    select doc_id, count(*) as total_fields, count(*) filter (f.exact_match) as fields_exact, count(*) filter (f.accepted_match) as fields_accepted, count(*) filter (f.field_found) as fields_found,
        round_even(avg(f.similarity), 4) as mean_similarity, round_even(avg(f.levenshtein_distance), 4) as mean_distance
    from field_cmp f where {ok} group by doc_id
), docs0 as (
    select t.doc_id, t.document_type, coalesce(total_fields, 0) as total_fields, coalesce(fields_exact, 0) as fields_exact, coalesce(fields_accepted, 0) as fields_accepted, coalesce(fields_found, 0) as fields_found,
        mean_similarity, mean_distance, t.similarity as ocr_text_similarity, t.accepted_match as ocr_is_good
    from text_cmp t left join doc_fields using (doc_id)
), docs as materialized (
    select *, total_fields > 0 and fields_exact = total_fields as document_accuracy_strict, total_fields > 0 and fields_accepted / total_fields >= 0.8 as document_accuracy_relaxed,
        case when total_fields > 0 then round_even(fields_exact / total_fields, 4) else 0.0 end as field_accuracy_strict, case when total_fields > 0 then round_even(fields_accepted / total_fields, 4) else 0.0 end as field_accuracy_relaxed,
        case when total_fields > 0 then round_even(fields_found / total_fields, 4) end as field_found_rate, ocr_is_good and not (total_fields > 0 and fields_accepted / total_fields >= 0.8) as parsing_error_given_good_ocr,
        not (total_fields > 0 and fields_accepted / total_fields >= 0.8) as end_to_end_error, total_fields = 0 or fields_accepted / total_fields < 0.5 or fields_found = 0 as severe_failure
    from docs0
)"""


def _group() -> str:
    share = lambda c: f"round_even(avg({c}::int), 4)"
    mean = lambda c: f"round_even(avg({c}), 4)"
    return f"""{share('document_accuracy_strict')} as document_accuracy_strict, {share('document_accuracy_relaxed')} as document_accuracy_relaxed, {mean('field_accuracy_relaxed')} as average_document_field_accuracy,
    {mean('mean_similarity')} as mean_similarity, {mean('mean_distance')} as mean_distance, {share('document_accuracy_strict')} as perfect_document_rate, {share('document_accuracy_relaxed')} as acceptable_document_rate,
    {share('severe_failure')} as severe_failure_rate, {mean('field_found_rate')} as field_found_rate, round_even(1 - {share('ocr_is_good')}, 4) as ocr_error_rate,
    round_even(avg(case when ocr_is_good then parsing_error_given_good_ocr::int end), 4) as parsing_error_rate_given_good_ocr, {share('end_to_end_error')} as end_to_end_error_rate"""


_LINES = "lines as (select doc_id, unnest(range(len(l))) as pos, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents))"
_WRITTEN = """written as (
    select o_orderkey, case when o_orderkey % 2 = 0 then 'data_nascimento' else 'validade' end as field_name, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%d/%m/%Y') when 1 then strftime(o_orderdate, '%-d-%-m-%y')
        when 2 then 'em ' || translate(strftime(o_orderdate, '%d/%m/%Y'), '01', 'OI') when 3 then '31/02/' || strftime(o_orderdate, '%Y') else 'sem data' end as written
    from orders
)"""
_WORDS = """l as (select doc_id, unnest(range(len(x))) as line, unnest(x) as t from (select doc_id, string_split(text, chr(10)) as x from documents)
), w as (select doc_id, line, unnest(range(len(x))) as w, unnest(x) as text from (select doc_id, line, string_split(t, ' ') as x from l)
), raw as (
    select *, doc_id * 31 + line * 17 + w * 7 as k from w
), words as (
    select doc_id, line * 100000 + w as pos, trim(text) as text, least(greatest(coalesce(try_cast(case when k % 29 = 0 then '-1' when k % 31 = 0 then 'n/a' when k % 37 = 0 then '250' else (k % 101)::varchar end as double), 0), 0), 100) as confidence,
        w * 50 % 977 as l, line * 20 as t, length(text) * 8 as wd, '1-1-1-' || line as line_key from raw
), good as (select * from words where text <> '' and confidence > 0)"""


def _scores() -> str:
    return """e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings where label is not null and embedding is not null
), cells as (select label, unnest(range(64)) as i, unnest(v) as x from e
), means as (select label, i, round(avg(x), 6) as m from cells group by label, i
), centres as (select label, list(m order by i) as c from means group by label
), logits as (
    select vec_id, e.label as true_label, c.label, -20.0 * round(sqrt(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 4) as z from e cross join centres c
), tops as (select vec_id, max(z) as top from logits group by vec_id
), exps as (select vec_id, true_label, label, exp(z - top) as x from logits join tops using (vec_id)
), probs as (select vec_id, true_label, label, x / sum(x) over (partition by vec_id) as p from exps
), scored as (select vec_id, any_value(true_label) as true_label, max(p) as max_probability, arg_max(label, p * 1000000 - label / 1000000.0) as predicted from probs group by vec_id)"""


def _report(rows: str, labels: list[str]) -> str:
    """SQL for (label, precision, recall, f1, support) over a CTE with t and p."""
    values = ", ".join(f"('{x}')" for x in labels)
    return f"""wanted as (select * from (values {values}) as v(label)
), counted as (
    select label, (select count(*) from {rows} where t = label and p = label) as tp, (select count(*) from {rows} where t = label) as support, (select count(*) from {rows} where p = label) as named from wanted
), rated as (select label, support, coalesce(tp / nullif(named, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall from counted
), each as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from rated
), report as (
    select label, precision, recall, f1, support from each
    union all select 'accuracy', a, a, a, n from (select avg((t = p)::int) as a, count(t) as n from {rows})
    union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from each
    union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from each
)"""


_PATHS = """named as (
    select p_partkey as k, lpad(p_partkey::varchar, 8, '0') as s, case when p_partkey % 11 = 0 then 'misc' when p_partkey % 13 = 0 then 'Desconhecido' else (['CNH_Frente', 'CNH_Verso', 'CPF_Frente', 'CPF_Verso', 'RG_Frente', 'RG_Verso'])[1 + (p_partkey % 6)::int] end as folder from part
), paths as (
    select folder, unnest([
        s || case k % 4 when 0 then '_in.JPG' when 1 then '__orig.jpg' when 2 then '__aug01.png' else '_photo.jpeg' end,
        s || case when k % 4 = 1 then '__orig_mask.jpg' when k % 5 = 0 then '_x.jpg' else '_gt_segmentation.jpg' end,
        s || case when k % 7 = 0 then '.csv' when k % 4 = 2 then '__aug01.txt' else '_gt_ocr.txt' end]) as name
    from named
), files as (
    select '/data/' || folder || '/' || name as path, folder, name, regexp_replace(name, '\\.[^.]+$', '') as stem, lower(regexp_extract(name, '\\.([^.]+)$', 1)) as ext from paths
), typed as (select *, folder in ('CNH_Frente', 'CNH_Verso', 'CPF_Frente', 'CPF_Verso', 'RG_Frente', 'RG_Verso') as known, ext in ('jpg', 'jpeg', 'png', 'bmp', 'tif', 'tiff') and not ends_with(stem, '_mask') as batch_image from files)"""
_SUFFIXES = "gt_segmentation|segmentation|documento|document|original|mascara|bboxes|gt_ocr|imagem|labels|boxes|image|label|bbox|mask|doc|img|ocr|gt|in"
_KEYED = f"""keyed as (
    select *, coalesce(nullif(trim(regexp_replace(stem, '(?i)(?:[_\\- ]*(?:{_SUFFIXES}))+$', ''), '_- '), ''), stem) as document_key,
        regexp_matches(lower(stem), 'mask|mascara|bbox|boxes|label|labels|gt|segmentation') as as_mask, regexp_matches(lower(stem), 'image|imagem|img|doc|document|documento|original|in') as as_image
    from typed
), grouped as (
    select folder as class_name, document_key as document_id, count(*) filter (ext = 'txt') as n_text, count(*) filter (ext <> 'txt') as n_image, list(path order by path) filter (ext <> 'txt') as images, max(path) filter (ext = 'txt') as annotation_path,
        list(path order by path) filter (ext <> 'txt' and as_mask) as masks, list(path order by path) filter (ext <> 'txt' and as_image) as named, list(path order by path) filter (ext <> 'txt' and not as_image) as others
    from keyed where ext in ('jpg', 'jpeg', 'png', 'txt') group by all
)"""
_ANNOTATIONS = """files as (
    select c_custkey::varchar as path, unnest([1, 3, 4]) as pos, unnest([(c_custkey * 7 % 500)::double, (c_custkey * 5 % 400)::double, list_min(xs)::double]) as x, unnest([(c_custkey * 11 % 300)::double, (c_custkey * 13 % 200)::double, list_min(ys)::double]) as y,
        unnest([(c_custkey * 3 % 90)::double, (c_custkey * 2 % 80)::double, (list_max(xs) - list_min(xs))::double]) as width, unnest([12.0::double, 9.5::double, (list_max(ys) - list_min(ys))::double]) as height, unnest([c_name, 'Rua A, 12', c_mktsegment]) as transcription
    from (select *, list_transform([17, 19, 23, 29], lambda a: c_custkey * a % 600) as xs, list_transform([31, 37, 41, 43], lambda a: c_custkey * a % 400) as ys from customer)
)"""


def _plan() -> str:
    fnv = "list_reduce(list_transform(string_split('42:' || class_name || ':' || document_id || ':' || variant, ''), lambda c: ord(c)::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::bigint)"
    return f"""base as (select p_brand as class_name, lpad(p_partkey::varchar, 8, '0') as document_id from part
), variants as (select *, unnest([1, 2]) as variant from base
), planned as (
    select class_name, document_id, variant, ({list(R.SCENARIOS)!r})[1 + ((row_number() over (partition by class_name order by document_id, variant) - 1) % 6)::int] as scenario, {fnv} as seed, true as is_augmented from variants
    union all select class_name, document_id, 0, 'original', 42, false from base
)"""


def _split() -> str:
    return """samples as (select doc_id, lang || '::' || (doc_id // 2) as group_id, lang as label from documents
), groups as (select group_id, min(label) as label from samples group by group_id
), sized as (select *, count(*) over (partition by label) as n, row_number() over (partition by label order by md5('42|' || group_id), group_id) as r from groups
), split_groups as (
    select group_id, case when r <= ceil(ceil(n * (0.2::double + 0.1::double)) * (0.1::double / (0.2::double + 0.1::double))) then 'test' when r <= ceil(n * (0.2::double + 0.1::double)) then 'val' else 'train' end as split from sized
), split_samples as (select group_id, doc_id, label, split from samples join split_groups using (group_id))"""


def oracle_sql() -> dict[str, str]:
    from .queries import AS_OF, CLASSES, LEAST_CONFIDENCE

    ocr = f"with {_cards()}, {_lines('ocr')}"
    found = f"{ocr}, {_fields('ocr')}"
    signals = f"{found}, {_signals('ocr', AS_OF)}"
    truth = f"{_lines('gt')}, {_fields('gt')}"
    compared = f"{signals}, {truth}, {_comparisons()}"
    documents = f"{compared}, {_documents()}"
    text = f"{ocr}, {_lines('gt')}, {_comparisons().partition('), texts as')[1].lstrip('), ')}{_comparisons().partition('), texts as')[2]}"
    labels = [str(c) for c in CLASSES]
    rate = lambda c: f"round_even(avg({c}::int), 4)"
    mean = lambda c: f"round_even(avg({c}), 4)"
    sig = "expected_label_found, came_after_expected_label, distance_to_label, regex_full_match, format_valid, candidate_count, conflict_with_other_candidates, minimum_expected_field, minimum_expected_field_found, cpf_has_11_digits, cpf_check_digits_valid, date_plausible"
    rules_only = lambda names: f"with {_cards()}, {_lines('ocr')}, {_fields('ocr')} " + names
    type_values = ", ".join(f"('{t}')" for t in (*R.TYPES, "all"))
    errors = f"""{documents}, judged as (
        select doc_id, document_type, (doc_id % 10 = 3) or (doc_id % 20 = 5) as rectification_error, not ocr_is_good as ocr_error, parsing_error_given_good_ocr as parsing_error,
            coalesce((select string_agg(field_name, ',' order by field_name) from field_cmp f where f.doc_id = docs.doc_id and ground_truth_available and not accepted_match), '') as problem_fields from docs
    ), errors as (
        select *, case when rectification_error and ocr_error then 'retificacao_imagem' when ocr_error then 'ocr' when parsing_error then 'parsing' when rectification_error then 'retificacao_sem_impacto_final_claro' else 'sem_erro_relevante' end as predominant_error from judged
    )"""
    sql = {
        "line_explode": f"with {_LINES} select doc_id, pos::int as pos, length(line)::int as n_chars, md5(line) as digest from lines where trim(line) <> ''",
        "norm_text": f"with {_LINES} select doc_id, pos::int as pos, {norm('line')} as norm from lines where trim(line) <> ''",
        "norm_compare": f"select conv_id, turn, {compact('text')} as compact from conversations",
        "scalars": f"select conv_id, turn, {noise('text')} as noise, {digits('text')} as digits, {clean('text')} as clean from conversations",
        "cpf_format_checksum": f"with {_cards()}, x as (select doc_id, cpf, {digits('cpf')} as d from cards) select doc_id, {dotted('d')} as formatted, {checksum('cpf')} as valid, (select {dotted('y')} from (select {first(noise('''('CPF ' || cpf || ' N. ' || substr(d, 1, 4))'''), CPF)} as y)) as found from x",
        "br_date_parse": f"with {_WRITTEN} select o_orderkey, {parsed('written')} as parsed, {standard('written')} as standard from written",
        "date_plausible": f"with {_WRITTEN} select o_orderkey, field_name, {plausible('written', 'field_name', '1996-06-30')} as plausible from written",
        "label_lines": f"{ocr} select doc_id, idx, norm, is_label, value from ocr_l",
        "label_candidates": f"{ocr}, spot as (select doc_id, min(idx) filter (contains(norm, 'NOME') or contains(norm, 'REGISTRO')) as label_idx from ocr_l group by doc_id) select spot.doc_id, any_value(label_idx) as label_idx, (count(l.value))::int as candidates from spot left join ocr_l l on l.doc_id = spot.doc_id and l.idx between label_idx - 4 and label_idx + 4 and l.idx <> label_idx group by spot.doc_id",
        "filiation_collect": rules_only("select d.doc_id, coalesce(array_to_string(n.names, '; '), '') as names from ocr_t d left join ocr_names n using (doc_id)"),
        "value_line": f"{signals} select doc_id, field_name, value_idx as line_idx, ocr_confidence as confidence from ocr_s where names is null",
        "extract_fields": f"{found} select doc_id, document_type, field_name, value, array_to_string(names, ' | ') as value_list from ocr_f",
        "parsing_signals": f"{signals} select doc_id, field_name, {sig} from ocr_s",
        "parsing_score": f"{signals} select doc_id, field_name, round_even(ocr_confidence, 4) as ocr_confidence, parsing_confidence, n_components from ocr_s",
        "quality_warnings": f"""{signals} select doc_id, 0 as ordinal, 'missing_field' as kind, m.field_name, null::double as confidence from ocr_t join minimum m using (document_type) where not exists (select 1 from ocr_f f where f.doc_id = ocr_t.doc_id and f.field_name = m.field_name)
            union all select doc_id, 1, 'low_ocr_confidence', field_name, round_even(ocr_confidence, 1) from ocr_s where ocr_confidence < {LEAST_CONFIDENCE}
            union all select doc_id, 2, 'low_parsing_confidence', field_name, round_even(parsing_confidence, 1) from ocr_s where parsing_confidence < {LEAST_CONFIDENCE}""",
        "field_comparison": f"{compared} select doc_id, field_name, predicted_value, ground_truth_value, field_found, ground_truth_available, exact_match, accepted_match, similarity, levenshtein_distance from field_cmp",
        "text_similarity": f"{text} select doc_id, exact_match, accepted_match, similarity, levenshtein_distance from text_cmp",
        "metrics_by_field": f"""{compared} select coalesce(field_name, '*') as field_name, count(*) as total, {rate('field_found')} as found_rate, {rate('exact_match')} as exact_accuracy, {rate('accepted_match')} as accepted_accuracy, {mean('similarity')} as mean_similarity,
            {mean('levenshtein_distance')} as mean_distance, {rate('regex_full_match')} as regex_rate, {rate('format_valid')} as format_rate, {rate('cpf_has_11_digits')} as cpf_11_digits_rate, {rate('cpf_check_digits_valid')} as cpf_valid_rate,
            {rate('date_plausible')} as date_plausible_rate, {mean('ocr_confidence')} as mean_ocr_confidence, {mean('parsing_confidence')} as mean_parsing_confidence from field_cmp where ground_truth_available group by grouping sets ((field_name), ())""",
        "batch_metrics": f"""{compared} select * from (select {mean('parsing_confidence')} as mean_parsing_confidence, {rate('conflict_with_other_candidates')} as conflict_rate, {rate('minimum_expected_field_found')} as minimum_field_rate, {mean('abs(distance_to_label)')} as mean_label_distance from ocr_s),
            (select count(*) as documents, {mean('mean_confidence')} as mean_ocr_confidence, {mean('n_lines')} as mean_lines, {mean('n_words')} as mean_words from ocr_t), (select {mean('similarity')} as mean_text_similarity from text_cmp where ground_truth_value <> '')""",
        "document_metrics": f"{documents} select * from docs",
        "doc_group_summary": f"{documents} select document_type, count(*) as documents, {_group()} from docs group by document_type",
        "executive_by_type": f"{documents}, g as (select coalesce(document_type, 'all') as document_type, count(*) as documents, {_group()} from docs group by grouping sets ((document_type), ())) select w.document_type, coalesce(g.documents, 0) as documents, g.* exclude (document_type, documents) from (values {type_values}) as w(document_type) left join g using (document_type)",
        "error_report": f"{errors} select * from errors",
        "predominant_error": f"{errors} select predominant_error, count(*) as documents from errors group by 1",
        "word_confidence": f"with {_WORDS} select d.doc_id, round_even(coalesce(avg(confidence), 0), 4) as mean_confidence, count(g.doc_id) as n_words from documents d left join good g using (doc_id) group by d.doc_id",
        "words_to_lines": f"with {_WORDS}, g as (select doc_id, line_key, md5(string_agg(text, ' ' order by l, pos, text)) as text_digest, round_even(avg(confidence), 4) as confidence, min(l) as \"left\", min(t) as top, max(l + wd) - min(l) as width, max(t + 12) - min(t) as height from good group by doc_id, line_key) select *, (row_number() over (partition by doc_id order by top, \"left\", line_key) - 1)::int as line_idx from g",
        "best_candidate": f"""{ocr}, two as (select doc_id, n_words, mean_confidence, 'rectified' as version, 0 as pref from ocr_t union all select doc_id, n_words, mean_confidence + case doc_id % 3 when 0 then 0.0 when 1 then 2.5 else -2.5 end, 'pre_ocr', 1 from ocr_t),
            r as (select *, row_number() over (partition by doc_id order by mean_confidence desc, n_words desc, pref desc) as r from two) select doc_id, version, n_words::int as n_words, round_even(mean_confidence, 4) as mean_confidence from r where r = 1""",
        "timing_stats": "select event_type as key, round_even(avg(value), 6) as mean, round_even(stddev_pop(value), 6) as std, round_even(min(value), 6) as min, round_even(max(value), 6) as max, count(value) as count from events group by 1",
        "softmax_predict": f"with {_scores()} select s.vec_id, s.true_label, s.predicted, round_even(s.max_probability, 6) as max_probability, {', '.join(f'round_even(max(p) filter (label = {c}), 6) as prob_{c}' for c in CLASSES)} from scored s join probs using (vec_id) group by all",
        "rejection_threshold": f"with {_scores()} select round_even(quantile_cont(max_probability, 0.05), 6) as threshold from scored",
        "confidence_analysis": f"""with {_scores()}, r as (select *, round(max_probability, 9) as m from scored), q as (select quantile_cont(m, 0.05) as threshold from r) select round_even(threshold, 6) as threshold, count(*) filter (m >= threshold)::double as accepted_count, count(*) filter (m < threshold)::double as rejected_count,
            round_even(count(*) filter (m < threshold) / count(*), 6) as rejection_rate, round_even(avg(case when m >= threshold then (true_label = predicted)::int end), 6) as accepted_accuracy from r, q group by threshold""",
        "confusion_matrix": f"with {_scores()}, l as (select unnest({labels!r}) as x) select a.x as true_label, b.x as predicted_label, (select count(*) from scored where true_label::varchar = a.x and predicted::varchar = b.x) as n from l a, l b",
        "classification_report": f"with {_scores()}, rows_ as (select true_label::varchar as t, predicted::varchar as p from scored), {_report('rows_', labels)} select label, round_even(precision, 6) as precision, round_even(recall, 6) as recall, round_even(f1, 6) as f1, support::bigint as support from report",
        "binary_report": f"with rows_ as (select quality::varchar as t, (n_chars >= 1000)::int::varchar as p from labels join documents using (doc_id)), {_report('rows_', ['0', '1'])} select label, round_even(precision, 6) as precision, round_even(recall, 6) as recall, round_even(f1, 6) as f1, support::bigint as support from report",
        "external_metrics": f"""with {_scores()}, x as (select case when vec_id % 17 = 0 then 'outros' when vec_id % 19 = 0 then null else true_label::varchar end as t, case when max_probability < 0.15 then 'outros' else predicted::varchar end as p, max_probability < 0.15 as rejected from scored),
            rows_ as (select t, p from x where t is not null), {_report('rows_', [*labels, 'outros'])}, m as (select 'external_total_images' as metric, count(*)::double as value from x union all select 'external_rejected_count', count(*) filter (rejected) from x union all select 'external_rejection_rate', avg(rejected::int) from x
            union all select 'external_labeled_images', count(*) from rows_ union all select 'external_accuracy_final', avg((t = p)::int) from rows_ union all select 'external_outros_recall', avg((t = p)::int) from rows_ where t = 'outros' union all select 'external_known_accuracy_final', avg((t = p)::int) from rows_ where t <> 'outros'
            union all select 'external_macro_f1_final', f1 from report where label = 'macro avg') select metric, round_even(value, 6) as value from m where value is not null""",
        "group_split": f"with {_split()} select * from split_samples",
        "split_leakage": f"with {_split()}, g as (select group_id, count(distinct split) as n from split_samples group by 1) select count(*) as groups, count(*) filter (n > 1) as leaking from g",
        "scenario_round_robin": f"with {_plan()} select * from planned",
        "augmentation_summary": f"with {_plan()} select class_name, scenario, is_augmented, count(*) as count from planned group by all",
        "manifest": f"with {_plan()}, s as (select *, '/out/' || class_name || '/' || document_id || '__' || case when is_augmented then 'aug' || lpad(variant::varchar, 2, '0') else 'orig' end as stem from planned) select class_name, document_id, variant, class_name as label, stem || '.jpg' as image_path, stem || '_mask.jpg' as mask_path, stem || '.txt' as annotation_path, stem || '.json' as sidecar_path from s",
        "path_facts": f"with {_PATHS}, {_KEYED} select path, batch_image, ext in ('jpg', 'jpeg', 'png', 'bmp', 'webp') and not ends_with(lower(name), '_mask.jpg') as inference_image, case when known then folder end as document_type, coalesce(nullif(regexp_extract(stem, '(?i)^(.+)__(orig|aug\\d+)$', 1), ''), string_split(stem, '__')[1]) as origin_id, document_key, case when known then folder when folder = 'Desconhecido' then 'outros' end as true_label from keyed",
        "ground_truth_join": f"with {_PATHS} select i.path, i.folder as document_type, t.path as ground_truth_path from typed i left join typed t on t.ext = 'txt' and t.folder = i.folder and t.stem = i.stem where i.batch_image and i.known",
        "triplet_grouping": f"with {_PATHS}, {_KEYED}, m as (select *, case when len(masks) = 1 then masks[1] when len(named) = 1 then others[1] else images[1] end as mask_path from grouped where n_text = 1 and n_image = 2) select class_name, document_id, case when mask_path = images[1] then images[2] else images[1] end as image_path, mask_path, annotation_path from m",
        "triplet_errors": f"with {_PATHS}, {_KEYED} select class_name, document_id, n_text, n_image from grouped where n_text <> 1 or n_image <> 2",
        "annotation_parse": f"with {_ANNOTATIONS} select * from files",
        "ground_truth_lines": f"""with {_ANNOTATIONS}, s as (select path, pos, case pos when 3 then '"Rua A, 12"' else transcription end as text from files), r as (select path, text, (row_number() over (partition by path order by pos) - 1)::int as line_idx from s where text <> '')
            select path, line_idx, text, 100.0::double as confidence, 0 as "left", line_idx * 20 as top, (greatest(length(text), 1) * 10)::int as width, 12 as height from r""",
        "bbox_convert": f"""with {_ANNOTATIONS}, e as (select path, pos, x as x_min, y as y_min, x + width as x_max, y + height as y_max from files), m as (select *, 500 - (y_max - 400) * 0.5 + 10 as a0, 500 - (y_min - 400) * 0.5 + 10 as a1, 400 + (x_min - 500) * 0.5 - 5 as b0, 400 + (x_max - 500) * 0.5 - 5 as b1 from e),
            c as (select *, greatest(0, least(a0, 1000)) as x0, greatest(0, least(a1, 1000)) as x1, greatest(0, least(b0, 800)) as y0, greatest(0, least(b1, 800)) as y1 from m), k as (select *, x1 - x0 >= 2 - 1e-9 and y1 - y0 >= 2 - 1e-9 as ok from c)
            select path, pos, x_min, y_min, x_max, y_max, case when ok then round_even(x0, 3) end as moved_x, case when ok then round_even(y0, 3) end as moved_y, case when ok then round_even(x1 - x0, 3) end as moved_width, case when ok then round_even(y1 - y0, 3) end as moved_height from k""",
        "point_order": """with p as (select c_custkey, list_transform([[3, 5], [7, 11], [13, 17], [19, 23]], lambda m: {'x': (c_custkey::bigint * m[1] % 997)::double, 'y': (c_custkey::bigint * m[2] % 991)::double}) as p from customer),
            s as (select c_custkey, list_sort(list_transform(p, lambda q: {'k': q.x + q.y, 'x': q.x, 'y': q.y})) as t, list_sort(list_transform(p, lambda q: {'k': q.y - q.x, 'x': q.x, 'y': q.y})) as g from p),
            o as (select c_custkey, t[1].x as x0, t[1].y as y0, g[1].x as x1, g[1].y as y1, t[4].x as x2, t[4].y as y2, g[4].x as x3, g[4].y as y3 from s)
            select *, greatest(1, floor(greatest(sqrt((x2 - x3) ** 2 + (y2 - y3) ** 2), sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2))))::int as width, greatest(1, floor(greatest(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2), sqrt((x0 - x3) ** 2 + (y0 - y3) ** 2))))::int as height from o""",
        "stage_window_counts": "select time_bucket(interval '1 day', ts) as window_start, event_type as stage, count(*) as n, round_even(avg(value), 6) as mean_value, max(value) as max_value from events group by 1, 2",
        "session_counts": "with a as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval '6 hours' or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events), b as (select *, sum(new) over (partition by user_id order by ts) as s from a) select user_id, min(ts) as session_start, max(ts) + interval '6 hours' as session_end, count(*) as n from b group by user_id, s",
        "routing": f"{signals} select document_type, case when ocr_confidence >= 55 then 'accept' when doc_id % 2 <> 0 then 'fallback' when parsing_confidence >= 55 then 'accept' else 'human_review' end as route, count(*) as fields from ocr_s group by 1, 2",
    }
    near = {"nome": ("NOME", None), "registro": ("N REGISTRO", "REGISTRO"), "categoria": ("CAT HAB", "CAT. HAB")}
    dates = {"nascimento": ("DATA NASCIMENTO", "NASCIMENTO"), "validade": ("VALIDADE", None), "expedicao": ("DATA EXPEDICAO", "EXPEDICAO")}
    for name, labels_, method in (("label_value_search", near, "value"), ("date_after_label", dates, "date")):
        rows = ", ".join(f"('{t}', '{f}', '{a}', {'null' if b is None else repr(b)}, '{method}', '')" for t in R.TYPES for f, (a, b) in labels_.items())
        body = _fields("ocr").partition("), ocr_follow as")[0].replace(_rules(("value", "date")), rows)
        value = "near_value" if method == "value" else f"case when near_value is not null then {first(noise('near_value'), DATE)} else found end"
        sql[name] = f"{ocr}, {body}) select doc_id, {', '.join(f'''max({value}) filter (field_name = '{f}') as {f}''' for f in labels_)} from ocr_near group by doc_id"
    return sql
