"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattloom.llm.op1_minhash import op1_minhash_dedup
from wattloom.llm.op2_embedding import op2_embedding_dedup
from wattloom.llm.op3_quality import op3_quality_rules
from wattloom.llm.op4_ann import op4_ann_search
from wattloom.llm.op5_secrets import op5_secret_scan
from wattloom.llm.op6_pitman_yor import op6_lm_score
from wattloom.llm.op7_toxicity import op7_toxicity
from wattloom.llm.op8_language import op8_language_id
from wattloom.llm.op9_pack import op9_best_fit_packing
from wattloom.llm.op10_mix import op10_source_mix
from wattloom.llm.op11_negatives import op11_hard_negatives
from wattloom.llm.op12_phrases import op12_phrases
from wattloom.llm.op13_archives import op13_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_ann_search": op4_ann_search,
    "op5_secret_scan": op5_secret_scan,
    "op6_lm_score": op6_lm_score,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_source_mix": op10_source_mix,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_phrases": op12_phrases,
    "op13_archives": op13_archives,
}

_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey"))
#: kind, pattern, the group whose length counts, and the least of it.
_SECRETS = (
    ("assign", rf"(?:{_NAMES})[\"\']?\x20*[:=]\x20*[\"\']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
    ("pem", "-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("forge", "gh[pousr]_[A-Za-z0-9]+", 0, 24),
    ("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)


def _secrets_sql() -> str:
    """Matches are marked in the text, which is then split at the marks: what comes before a part gives its place."""

    def found(k: int, kind: str, pattern: str, group: int, least: int) -> str:
        pattern = pattern.replace("'", "''")
        return f"""
    select doc_id, {k} as k, '{kind}' as kind, place + 1 - i as start, length(hit) as size from (
        select doc_id, i, split_part(part, chr(57345), 1) as hit, coalesce(sum(length(part)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as place
        from (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as i
              from (select doc_id, string_split(regexp_replace(coalesce(text, ''), '{pattern}', chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) as parts from documents) as m) as n) as o
    where i > 0 and length(regexp_extract(hit, '{pattern}', {group})) >= {least}"""

    kinds = " union all ".join(found(k, *rule) for k, rule in enumerate(_SECRETS))
    listed = "string_agg(kind || ':' || start || ':' || (start + size), ',' order by start, k)"
    return f"""
    with s as ({kinds}),
    a as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
        coalesce({listed} filter (where k < 3), '') as base, {listed} as spans from s group by doc_id)
    select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from documents d left join a on a.doc_id = d.doc_id"""


#: Searches, scores, draws and plans are beyond SQL; tests hold them against brute force and held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op13_archives": """
    with p as (select page_id, coalesce(html, '') as html from pages),
    f as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest, min(page_id) over (partition by html) as first from p)
    select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
        case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f""",
    "op12_phrases": r"""
    with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    words as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
    n as (select lang, sum(len(ws))::bigint as n from words group by 1),
    grams as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase from words cross join range(1, 6) as r(k) where len(ws) >= k),
    f as (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 100),
    c as (select *, string_split(phrase, ' ') as ws from f where k > 1),
    cuts as (select c.lang, c.phrase, c.f as a, j, l.f as l, r.f as r, (1000::hugeint * c.f * n.n) // (l.f::hugeint * r.f) as score
        from c cross join range(1, 5) as x(j) join n on n.lang = c.lang
        join f l on l.lang = c.lang and l.phrase = array_to_string(c.ws[:j], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.ws[j + 1:], ' ') where j < c.k),
    least as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
    free as (select * from least where not exists (select 1 from c where c.lang = least.lang and c.f >= least.a and c.phrase <> least.phrase and contains(' ' || c.phrase || ' ', ' ' || least.phrase || ' '))),
    ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from free join n using (lang))
    select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked where rank <= 2000""",
    "op11_hard_negatives": """
    with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
        where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    s as (select a.vec_id as anchor_id, c.vec_id as cand_id, a.label = c.label as same, list_dot_product(a.e, c.e)::bigint as score from v a join v c on a.vec_id % 50 = 0 and a.vec_id <> c.vec_id and len(a.e) = len(c.e)),
    p as (select anchor_id, cand_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, cand_id) <= 5),
    n as (select p.anchor_id, positive_id, positive_score, cand_id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, cand_id)::int as rank
        from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3""",
    "op5_secret_scan": _secrets_sql(),
    "op1_minhash_dedup": r"""
    with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
    s as (select doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as shingle from w),
    c as (select doc_id, shingle, count(*) as n from s group by 1, 2),
    t as (select doc_id, sum(n) as total from c group by 1),
    p as (select a.doc_id as x, b.doc_id as y, sum(least(a.n, b.n)) as o from c a join c b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
    half as (select x, y from p join t a on a.doc_id = x join t b on b.doc_id = y where o >= 0.8 * (a.total + b.total - o)),
    l as (select x, y from half union all select y, x from half),
    reach(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from reach r join l on r.y = l.x)
    select x as doc_id, min(y) as class_id, x = min(y) as kept from reach group by x""",
    "op2_embedding_dedup": """
    with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
        where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
    reach(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.y from reach r join l on r.y = l.x)
    select e.vec_id, (select count(*) from l where l.x = e.vec_id) as n_links, m.component_id, e.vec_id = m.component_id as kept
    from embeddings e join (select x, min(y) as component_id from reach group by x) m on m.x = e.vec_id""",
}
