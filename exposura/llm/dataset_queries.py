"""Registered queries of the operators on whole datasets (shards, manifest, conversations), with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from exposura.llm.conversations import DELETE_COST, INSERT_COST, KEY_CHARS, REROLE_COST, TRUNCATED_COST, audit_conversations, damage
from exposura.llm.manifest import FANOUT, FIELDS, manifest
from exposura.llm.sharding import shard_documents

SHARDS = 16


def op11_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{folder}/documents.parquet"), [1.0] * SHARDS)


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return audit_conversations(damage(spark.read.parquet(f"{folder}/conversations.parquet")))


def _crc_steps() -> list[int]:
    """CRC-32 of the sixteen half bytes."""
    steps = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        steps.append(value)
    return steps


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes in DuckDB, half a byte at a time."""
    def digit(of: str) -> str:
        return f"instr('123456789ABCDEF', {of})"

    def step(state: str, value: str) -> str:
        return f"xor(({_crc_steps()}::bigint[])[(xor({state}, {value}) & 15) + 1], ({state}) >> 4)"

    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ({digit('h[1]')} * 16 + {digit('h[2]')})::bigint)"
    return f"xor(list_reduce({octets}, lambda c, b: {step(step('c', 'b'), 'b >> 4')}, 4294967295::bigint), 4294967295)"


def _draw_sql(shard: int) -> str:
    return f"""{{'draw': -ln((('0x' || md5(key || ':{shard}')[1:13])::bigint + 0.5::double) / {1 << 52}::double), 'shard': {shard}}}"""


_SHARDS_SQL = f"""
with keyed as (
  select doc_id, coalesce(doc_id::varchar, 'null') as key, (strlen(coalesce(text, '')) + 1)::bigint as size,
    {crc32_sql("coalesce(text, '')")}::bigint as text_crc32
  from documents
),
sharded as (
  select *, list_min([{', '.join(_draw_sql(s) for s in range(SHARDS))}]).shard as shard,
    list_min([{', '.join(_draw_sql(s) for s in range(SHARDS + 1))}]).shard as grown_shard
  from keyed
)
select doc_id, size, text_crc32, 'key' as law, shard, grown_shard,
  row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot
from sharded
"""

# Levels of each tree that the SQL spells out: enough for 16**5 rows of a source and as many sources.
_LEVELS = 5


def _row_digest_sql(columns: dict[str, str]) -> str:
    parts = [f"coalesce(strlen(({c})::varchar)::varchar || ':' || ({c})::varchar, '-')" for c in columns.values()]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str) -> str:
    """Levels of the trees of ``{name}0(tree, pos, n, digest)``, and the siblings of every node."""
    steps = []
    for k in range(_LEVELS):
        steps.append(f"""{name}{k + 1} as (
  select tree, pos // {FANOUT} as pos, (n + {FANOUT - 1}) // {FANOUT} as n,
    case when n > 1 then sha256(string_agg(digest, '' order by pos)) else max(digest) end as digest
  from {name}{k} group by tree, pos // {FANOUT}, n
)""")
        side = f"(partition by tree, pos // {FANOUT} order by pos rows between"
        steps.append(f"""{name}_beside{k} as (
  select tree, pos, coalesce(string_agg(digest, '') over {side} unbounded preceding and 1 preceding), '') as before,
    coalesce(string_agg(digest, '') over {side} 1 following and unbounded following), '') as after
  from {name}{k} where n > 1
)""")
    return ",\n".join(steps)


def _walk_sql(name: str, start: str, tree: str, pos: str) -> str:
    """The rows of ``start``, led up the trees of ``name``: ``folded`` and ``proof`` grow step by step."""
    steps = []
    for k in range(_LEVELS):
        source = start if k == 0 else f"{name}_walk{k - 1}"
        steps.append(f"""{name}_walk{k} as (
  select w.* replace (
    case when b.pos is null then folded else sha256(b.before || folded || b.after) end as folded,
    proof || coalesce(b.before || b.after, '') as proof)
  from {source} w left join {name}_beside{k} b on b.tree = w.{tree} and b.pos = w.{pos} // {FANOUT ** k}
)""")
    return ",\n".join(steps)


_LOWERED = {c: "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if c == "text" else c for c in FIELDS}
_MANIFEST_SQL = f"""
with leaves as (
  select doc_id, source, {_row_digest_sql({c: c for c in FIELDS})} as leaf,
    case when {crc32_sql("doc_id::varchar")} % 5 = 0 then {_row_digest_sql(_LOWERED)} end as found
  from documents
),
placed as (
  select *, dense_rank() over (order by source nulls first) - 1 as tree, count(*) over (partition by source) as n,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos
  from leaves
),
s0 as (select tree, pos, n, leaf as digest from placed),
{_tree_sql("s")},
t0 as (select -1 as tree, tree as pos, count(*) over () as n, digest from s{_LEVELS}),
{_tree_sql("t")},
start as (select *, coalesce(found, leaf) as folded, '' as proof, -1 as top from placed),
{_walk_sql("s", "start", "tree", "pos")},
{_walk_sql("t", f"s_walk{_LEVELS - 1}", "top", "tree")}
select doc_id, leaf, s.digest as subroot, r.digest as root, sha256(proof) as proof_sha256, folded as folded_root,
  folded = r.digest as verified
from t_walk{_LEVELS - 1} w join s{_LEVELS} s on s.tree = w.tree join t{_LEVELS} r on r.tree = -1
"""

def _choice_sql(cost: str, edit: str, state: int, when: str = "true") -> str:
    return f"case when {when} then {{'c': {cost} + w.c[{state}], 'e': '{edit}' || w.e[{state}]}} end"


def _best_sql(state: int) -> str:
    """Cheapest edit of a row in a state (1 nothing yet, 2 after system, 3 after user, 4 after assistant) and what follows."""
    onward = 4 if state == 3 else 3
    initials = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}[state]
    extra = f"(case when fault = 'truncated' then {TRUNCATED_COST} else 0 end)"
    free = "fault not in ('blank', 'duplicate')"
    return "list_min([" + ", ".join([
        _choice_sql(str(DELETE_COST), "D", state),
        *[_choice_sql(extra, "K", to, f"{free} and role[1] = '{initial}'") for initial, to in initials.items()],
        _choice_sql(f"{extra} + {REROLE_COST}", "R", onward, free),
    ]) + "])"


def _inserted_sql(times: int, state: int) -> str:
    return f"{{'c': {INSERT_COST * times} + b{state}.c, 'e': '{'I' * times}' || b{state}.e}}"


_WHITE_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_REPAIR_SQL = f"""
with recursive kinds as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind
  from conversations
),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from kinds where kind <> 0
),
ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role[1:{KEY_CHARS}], text[1:{KEY_CHARS}],
    sha256(strlen(role)::varchar || ':' || role || text), copy) as i, rtrim(text, {_WHITE_SQL}) as filled
  from damaged
),
faulty as (
  select conv_id, turn, role, text, i, lead(role) over (partition by conv_id order by i) as next_role,
    case when filled = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
      when filled[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault
  from ordered
),
counts as (
  select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    count_if(fault = 'blank')::bigint as blank, count_if(fault = 'duplicate')::bigint as duplicate,
    count_if(fault = 'truncated')::bigint as truncated,
    count_if(next_role is not null and role[1] || next_role[1] not in ('su', 'ua', 'au'))::bigint as illegal
  from faulty group by conv_id
),
walk(conv_id, i, c, e) as (
  select conv_id, n + 1, [0, {2 * INSERT_COST}, {INSERT_COST}, 0], ['', 'II', 'I', ''] from counts
  union all
  select conv_id, i, [o1.c, o2.c, o3.c, o4.c], [o1.e, o2.e, o3.e, o4.e] from (
    select conv_id, i, list_min([b1, {_inserted_sql(1, 3)}, {_inserted_sql(2, 4)}]) as o1,
      list_min([b2, {_inserted_sql(1, 3)}, {_inserted_sql(2, 4)}]) as o2,
      list_min([b3, {_inserted_sql(1, 4)}]) as o3, list_min([b4, {_inserted_sql(1, 3)}]) as o4
    from (
      select w.conv_id, f.i, {_best_sql(1)} as b1, {_best_sql(2)} as b2, {_best_sql(3)} as b3, {_best_sql(4)} as b4
      from walk w join faulty f on f.conv_id is not distinct from w.conv_id and f.i = w.i - 1
    )
  )
),
audits as (select conv_id, c[1]::bigint as cost, e[1] as audit from walk where i = 1),
edits as (
  select conv_id, k, edit, count_if(edit <> 'I') over so_far as i, count_if(edit <> 'D') over so_far as o
  from (select conv_id, unnest(range(1, len(audit) + 1)) as k, audit[k] as edit from audits)
  window so_far as (partition by conv_id order by k)
),
written as (
  select e.conv_id, k, o, edit, f.role, case when edit = 'I' then '' else f.text end as text,
    max(case when o = 1 and edit = 'K' and f.role[1] = 's' then 1 else 0 end) over (partition by e.conv_id) as system
  from edits e left join faulty f on f.conv_id is not distinct from e.conv_id and f.i = e.i where edit <> 'D'
),
digests as (
  select conv_id, sha256(string_agg(case when edit = 'K' then role when (o - system) % 2 = 1 then 'user' else 'assistant' end
    || ':' || text, chr(10) order by k)) as repaired_sha256
  from written group by conv_id
)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit,
  coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) a
left join counts c on c.conv_id is not distinct from a.conv_id
left join audits t on t.conv_id is not distinct from a.conv_id
left join digests d on d.conv_id is not distinct from a.conv_id
"""

QUERIES = {
    "op11_rendezvous_shards": op11_rendezvous_shards, "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {
    "op11_rendezvous_shards": _SHARDS_SQL, "op12_merkle_manifest": _MANIFEST_SQL, "op13_conversation_repair": _REPAIR_SQL,
}
