"""The queries of this subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

from functools import wraps

from .alignment import op11_alignment
from .common import small_batches
from .decontamination import op5_decontamination
from .fingerprints import op8_fingerprints
from .hard_negatives import op12_hard_negatives
from .language_id import langid_pages, op6_language_id
from .near_dedup import op7_near_dedup
from .pii import op2_pii
from .quality import op1_quality
from .secret_scan import op3_secret_scan
from .sentencepiece_bpe import op4_sentencepiece
from .sharding import op13_sharding, op13_sql
from .substring_dedup import op10_substring_dedup
from .toxicity import op9_toxicity


def _begun(query):
    @wraps(query)
    def run(spark, sf_dir):
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    every = {"op1_quality": op1_quality, "op2_pii": op2_pii, "op3_secret_scan": op3_secret_scan, "op4_sentencepiece": op4_sentencepiece, "op5_decontamination": op5_decontamination, "op6_language_id": op6_language_id, "op7_near_dedup": op7_near_dedup, "op8_fingerprints": op8_fingerprints, "op9_toxicity": op9_toxicity, "op10_substring_dedup": op10_substring_dedup, "op11_alignment": op11_alignment, "op12_hard_negatives": op12_hard_negatives, "op13_sharding": op13_sharding, "langid_pages": langid_pages}
    return {name: _begun(query) for name, query in every.items()}


_WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

NEAR_DEDUP = f"""with recursive w as (select doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ws from documents),
 e as (select doc_id, unnest(case when len(ws) >= 4 then list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) s from w),
 d as (select distinct doc_id, s from e), n as (select doc_id, count(*) n from d group by doc_id),
 pairs as (select a.doc_id a, b.doc_id b, count(*) k from d a join d b on a.s = b.s and a.doc_id <> b.doc_id group by all),
 links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
 reach as (select doc_id, doc_id as other from w union select r.doc_id, l.b from reach r join links l on l.a = r.other),
 c as (select doc_id, min(other) component_id from reach group by doc_id)
 select c.doc_id, coalesce(n, 0)::bigint n_shingles, component_id, c.doc_id = component_id kept from c left join n using (doc_id)"""

SUBSTRING_DEDUP = f"""with w as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} ws from documents),
 p as (select doc_id, ws, unnest(generate_series(1, len(ws) - 34)) s from w where len(ws) >= 35),
 h as (select doc_id, s, array_to_string(ws[s:s + 34], ' ') k from p),
 r as (select k from h group by k having count(*) > 1),
 c as (select distinct doc_id, unnest(generate_series(s, s + 34)) i from h semi join r using (k)),
 words as (select doc_id, unnest(ws) word, unnest(generate_series(1, len(ws))) i from w),
 kept as (select doc_id, string_agg(word, ' ' order by i) t from words anti join c using (doc_id, i) group by doc_id),
 gone as (select doc_id, count(*) n from c group by doc_id)
 select w.doc_id, len(ws)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from w left join kept using (doc_id) left join gone using (doc_id)"""


HARD_NEGATIVES = """with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id anchor_id, b.vec_id other, a.l = b.l same, list_inner_product(a.v, b.v)::bigint score from r a join r b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
 p as (select anchor_id, other positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
 select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other)::integer rank, other negative_id, positive_score, score negative_score
 from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score qualify rank <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op7_near_dedup": NEAR_DEDUP, "op10_substring_dedup": SUBSTRING_DEDUP, "op12_hard_negatives": HARD_NEGATIVES, "op13_sharding": op13_sql()}
