"""DuckDB SQL for the rows of the queries that SQL can state."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Words in any occurrence of an item's window of eight words, by joining runs of words.
OP1 = f"""
with docs as (select doc_id, {_WORDS} ws from documents),
items as (select item_id, {_WORDS} ws from benchmark where item_id is not null),
starts as (select item_id, ws, least(8, len(ws)) k, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) i from items where len(ws) > 0),
windows as (select distinct item_id, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') g from starts),
runs as (select doc_id, i, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') g from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) i from docs, (select distinct k from windows) where len(ws) >= k)),
hits as (select doc_id, i, k, item_id from runs join windows using (k, g)),
words as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + k)) p from hits) group by 1),
found as (select doc_id, list_sort(list(distinct item_id::varchar)) ids from hits group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(n, 0)::bigint n_hit, coalesce(len(ids), 0)::bigint n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) items_sha256, coalesce(len(ids), 0) >= 2 contaminated
from docs left join words using (doc_id) left join found using (doc_id)"""

#: Components of all pairs that share enough two-word shingles, by joining shingles and following links.
OP3 = rf"""
with recursive split as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x09-\x0D\x20]+'), lambda x: x <> '') ws from documents),
sets as (select doc_id, case when len(ws) < 2 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end own from split),
parts as (select doc_id, unnest(own) s from sets),
shared as (select a.doc_id a, b.doc_id b, count(*) n from parts a join parts b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 80 * (len(x.own) + len(y.own) - n)),
reach(a, b) as (select doc_id, doc_id from documents union select a, links.b from reach join (select a l, b from links) links on reach.b = links.l)
select doc_id, len(own)::bigint n_shingles, component component_id, doc_id = component kept
from sets join (select a, min(b) component from reach group by 1) on a = doc_id"""

_BITS = "array_to_string(list_transform(string_split(upper(sha1(coalesce(html, ''))), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789ABCDEF', c)]), '')"
_FIVE = " + ".join(f"substr(bits, 5 * i + {k}, 1)::int * {1 << (5 - k)}" for k in range(1, 6))

#: Digests and revisits of equal payloads.
OP4 = f"""
with hashed as (select page_id, strlen(coalesce(html, ''))::bigint payload_bytes, {_BITS} bits from pages),
told as (select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') payload_digest, max(page_id) over (partition by bits) keeper from hashed)
select page_id, payload_bytes, payload_digest, case when page_id = keeper then 'response' else 'revisit' end record_type, case when page_id <> keeper then keeper end refers_to from told"""

_TURNS = "(select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')"
_COUNT = lambda c, s: f"(length({c}) - length(replace({c}, '{s}', ''))) // {len(s)}"
#: An escaped text's length: one more for each backslash and each control string.
_ESCAPED = lambda c: f"length({c}) + " + " + ".join(_COUNT(c, s) for s in ("\\", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"))

#: Digests of all turns and of all assistant texts, and the lengths that the template and its escapes give.
OP7 = f"""
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
  sum({len("<s>[INST][/INST]</s>")} + {_ESCAPED("role")} + {_ESCAPED("text")})::bigint formatted_chars, count(*) filter (role = 'assistant') n_examples
from {_TURNS} group by 1"""
