"""The registered queries, one for each operator of the survey, with their DuckDB counterparts.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import audio, mp4, naming, stft, text
from .operators import catalog, jobs, separate, signal
from .plans import process
from .sources import collection, files, logs, scratch, wav
from .views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ROOT = "/Outputs"
LENGTH, STRIDE = 32, signal.stride_of(32, 0.1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql)
        return f

    return add


# --- names ---------------------------------------------------------------------------------------

_NATIVE = r"""
ids as (select pos, audio_id, from_base64(audio_id) b from v_collection),
words as (select pos, audio_id, list_transform(range(64), lambda w:
    ('0x' || hex(b[4*w+4:4*w+4]) || hex(b[4*w+3:4*w+3]) || hex(b[4*w+2:4*w+2]) || hex(b[4*w+1:4*w+1]))::bigint) w from (select pos, audio_id, hex(b) hx, b from ids) q),
k as (select list_transform(range(64), lambda i: floor(abs(sin(i+1)) * 4294967296)::bigint) k,
    [7,12,17,22,5,9,14,20,4,11,16,23,6,10,15,21] s),
fold as (
  select pos, audio_id, w, 0 n, 1732584193::bigint a, 4023233417::bigint b, 2562383102::bigint c, 271733878::bigint d,
    1732584193::bigint a0, 4023233417::bigint b0, 2562383102::bigint c0, 271733878::bigint d0 from words
  union all
  select pos, audio_id, w, n + 1,
    case when i = 63 then (a0 + d) & 4294967295 else d end,
    case when i = 63 then (b0 + nb) & 4294967295 else nb end,
    case when i = 63 then (c0 + b) & 4294967295 else b end,
    case when i = 63 then (d0 + c) & 4294967295 else c end,
    case when i = 63 then (a0 + d) & 4294967295 else a0 end,
    case when i = 63 then (b0 + nb) & 4294967295 else b0 end,
    case when i = 63 then (c0 + b) & 4294967295 else c0 end,
    case when i = 63 then (d0 + c) & 4294967295 else d0 end
  from (
    select *, (b + (((x << sh) & 4294967295) | (x >> (32 - sh)))) & 4294967295 nb from (
      select fold.*, n % 64 i, s[4 * ((n % 64) // 16) + n % 4 + 1] sh,
        (a + case (n % 64) // 16 when 0 then (b & c) | ((4294967295 - b) & d) when 1 then (d & b) | ((4294967295 - d) & c)
                  when 2 then xor(xor(b, c), d) else xor(c, b | (4294967295 - d)) end
         + k.k[n % 64 + 1]
         + case when n >= 256 then 0 else w[16 * (n // 64) + 1 + case (n % 64) // 16 when 0 then n % 16 when 1 then (5 * (n % 64) + 1) % 16
                  when 2 then (3 * (n % 64) + 5) % 16 else (7 * (n % 64)) % 16 end] end) & 4294967295 x
      from fold, k where n < 320) q) r),
names as (
  select pos, lpad((a & 127)::varchar, 3, '0') bucket,
    list_aggregate(list_transform(range(28), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ012345',
      (([a, b, c, d][j // 7 + 1] >> (5 * (j % 7))) & 31)::int + 1, 1)), 'string_agg', '') || '.stem.mp4' name
  from fold where n = 320)
"""


def _collection(spark, sf_dir) -> DataFrame:
    v = view(spark, sf_dir, "v_collection")
    return v.withColumn("path", text.collection_path(F.col("dir_value"), F.col("file_value")))


@query("with " + _NATIVE.strip() + " select pos, bucket, name, concat('/Outputs/', bucket, '/', name) path from names")
def native_name(spark, sf_dir):
    """SC6 to SC11: bucket, file name and path from the audio id."""
    words = F.col("words")
    v = view(spark, sf_dir, "v_collection").withColumn("words", naming.hash_words(F.col("audio_id")))
    return v.select("pos", naming.bucket(words).alias("bucket"), naming.file_name(words).alias("name"), naming.native_path(ROOT, words).alias("path"))


@query("with " + _NATIVE.strip() + """ select i.pos, name computed, name = case when i.pos % 2 = 0 then name else 'x.stem.mp4' end matches
  from names join (select pos from v_collection) i on names.pos = i.pos""")
def calibrate(spark, sf_dir):
    """FLT10, JN2: whether an existing file has the computed name."""
    v = view(spark, sf_dir, "v_collection").withColumn("words", naming.hash_words(F.col("audio_id")))
    existing = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("/Outputs/001/"), naming.file_name(F.col("words")))).otherwise("/Outputs/x.stem.mp4")
    return v.select("pos", naming.file_name(F.col("words")).alias("computed"), naming.calibration(F.col("words"), existing)[naming.ALGORITHM].alias("matches"))


# --- catalog -------------------------------------------------------------------------------------

_SCAN = r"""
f as (select pos, path, size, regexp_extract(path, '([^/]*)$', 1) nm from v_files),
s as (select *, lower(regexp_extract(nm, '\.([^.]+)$', 1)) ext, regexp_replace(nm, '\.[^.]+$', '') stem,
      trim(regexp_replace(regexp_replace(nm, '\.[^.]+$', ''), '^\s*\d+\s*-\s*', '')) bare from f),
p as (select *, list_filter(list_transform(string_split(bare, ' - '), lambda x: trim(x)), lambda x: x <> '') parts from s),
scanned as (
  select pos, path, size, case when len(parts) >= 2 then array_to_string(parts[2:], ' - ') when bare <> '' then bare else stem end title,
    case when len(parts) >= 2 then parts[1] end artist
  from p where ext in ('flac','wav','aiff','aif','mp3','m4a','alac'))"""
_ENTRIES = r"""
entries as (select pos, nfc_normalize(concat(regexp_replace(replace(replace(dir_value, '/:', '/'), ':', ''), '/+$', ''), '/', file_value)) path, title, artist, audio_id, flags
  from v_collection),
found as (select path key, max(pos) last_pos, arg_max({'t': title, 'a': artist, 'i': audio_id}, pos) e from entries group by path)"""
_ENRICHED = f"""{_SCAN},{_ENTRIES},
enriched as (select s.pos, s.path, size, coalesce(nullif(e.t, ''), title) title, coalesce(nullif(e.a, ''), artist) artist, e.i audio_id
  from scanned s left join found on nfc_normalize(s.path) = key)"""


def _scanned(spark, sf_dir) -> DataFrame:
    return catalog.tracks(view(spark, sf_dir, "v_files"))


def _enriched(spark, sf_dir) -> DataFrame:
    return catalog.enrich(_scanned(spark, sf_dir), catalog.collection_index(_collection(spark, sf_dir)))


@query(f"with {_SCAN.strip()} select pos, title, artist, case when artist is null then title else concat(artist, ' - ', title) end display from scanned")
def filename_title_artist(spark, sf_dir):
    """SRC2, FLT1, PRJ1, PRJ2: title, artist and display name from file names."""
    s = _scanned(spark, sf_dir)
    return s.select("pos", "title", "artist", text.display_name(F.col("artist"), F.col("title")).alias("display"))


@query(f"with {_ENRICHED.strip()} select path, title, artist, audio_id from enriched")
def scan_enriched(spark, sf_dir):
    """SRC1 to SRC3, PRJ3 to PRJ5, JN1, JN1a, AG2: scanned files with the collection's values."""
    return _enriched(spark, sf_dir).select("path", "title", "artist", "audio_id")


@query(f"""with {_SCAN.strip()} select * from (
  select row_number() over (order by string_split(path, '/')) ordinal, count(*) over () total, path from scanned) q order by ordinal limit 100""")
def scan_topn(spark, sf_dir):
    """OR1, OR4, WN7, AG1: the first hundred paths in component order, with ordinal and total.

    The ordinal is given after the limit, so no task numbers all rows.
    """
    s = _scanned(spark, sf_dir).select("path")
    first = s.orderBy(text.path_order(F.col("path"))).limit(100)
    ordinal = F.expr("row_number() over (order by split(path, '/'))")
    return first.crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("total")))).select(ordinal.cast("bigint").alias("ordinal"), "total", "path")


@query(f"""with {_ENRICHED.strip()} select concat(case when nullif(audio_id, '') is null then 'no-audio-id' else 'matched' end, chr(9),
  case when nullif(artist, '') is null then title else concat(artist, ' - ', title) end, chr(9), path) as value from enriched""")
def scan_listing(spark, sf_dir):
    """SNK10: tab-separated listing."""
    return catalog.listing(_enriched(spark, sf_dir))


_LOGGED = r"""
lg as (select line_no, regexp_extract(line, 'Finished stem separation job for track "(.*?)" - result: successful: stem file stored to "(.*?)", with offset ([^,]+)', 1) title,
   regexp_extract(line, 'Finished stem separation job for track "(.*?)" - result: successful: stem file stored to "(.*?)", with offset ([^,]+)', 2) path,
   regexp_extract(line, 'Finished stem separation job for track "(.*?)" - result: successful: stem file stored to "(.*?)", with offset ([^,]+)', 3) as "offset"
   from v_log where line like '%Finished stem separation job%'),
logged as (select title, arg_max(path, line_no) logged_path from lg where path like '/Outputs/%' group by title)"""


@query(f"with {_LOGGED.strip()} select line_no, title, path, \"offset\" from lg")
def log_entries(spark, sf_dir):
    """SRC4, FLT3: stored-file lines of the log."""
    return logs.entries(view(spark, sf_dir, "v_log"))


@query(f"with {_LOGGED.strip()} select title, logged_path from logged")
def log_latest_path(spark, sf_dir):
    """JN3, FLT4, OR2: each title's last path under the root."""
    return catalog.latest_logged(logs.entries(view(spark, sf_dir, "v_log")), ROOT)


@query("with " + _NATIVE.strip() + f",{_LOGGED}" + """ select v.pos, coalesce(logged_path, concat('/Outputs/', bucket, '/', name)) output_path,
  logged_path is not null logged from (select pos, concat('T', floor(pos / 4)::bigint::varchar) title from v_collection) v
  left join logged on v.title = logged.title join names on names.pos = v.pos""")
def output_choice(spark, sf_dir):
    """PRJ7: the logged path, else the computed one."""
    v = _collection(spark, sf_dir).withColumn("title", F.concat(F.lit("T"), F.floor(F.col("pos") / 4).cast("string")))
    logged = catalog.latest_logged(logs.entries(view(spark, sf_dir, "v_log")), ROOT)
    out = catalog.output_paths(v, logged, ROOT).join(logged, "title", "left")
    return out.select("pos", F.col("output").alias("output_path"), F.col("logged_path").isNotNull().alias("logged"))


@query("""with e as (select *, dir_value || file_value p from v_collection), l as (select p, max(pos) last_pos from e group by p)
  select e.pos, case when l.last_pos = e.pos and e.pos % 2 = 0 then coalesce(flags, 0) | 64 else flags end flags,
    l.last_pos = e.pos and e.pos % 2 = 0 found, l.last_pos = e.pos and e.pos % 2 = 0 and (coalesce(flags, 0) & 64) = 0 changed,
    (coalesce(flags, 0) & 64) <> 0 was_set
  from e join l on e.p = l.p""")
def flag_update(spark, sf_dir):
    """SNK6, SNK7, JN6: sets the generated bit of finished tracks' last entries."""
    entries = _collection(spark, sf_dir).select("pos", "path", "flags")
    done = entries.where("pos % 2 = 0").join(entries.groupBy("path").agg(F.max("pos").alias("pos")), ["path", "pos"])
    was = entries.select("pos", catalog.flagged(F.col("flags")).alias("was_set"))
    return catalog.mark_generated(entries, done).join(was, "pos").select("pos", "flags", "found", "changed", "was_set")


@query("""select arg_max(path, {'v': v, 'm': mtime}) path, count(*) candidates from (
  select *, list_transform(list_filter(string_split(regexp_extract(path, 'Deck\\s+([0-9][0-9.]*)', 1), '.'), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: x::int) v from (
    select concat('/Docs/Deck ', p_size % 5, '.', p_size, '.', p_partkey % 13, '/collection.xml') path, p_partkey mtime from part) q) r""".replace("\\\\", "\\"))
def collection_pick(spark, sf_dir):
    """SRC6, SC5, AG3, OR3: the newest collection by version, then time."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    paths = part.selectExpr("concat('/Docs/Deck ', p_size % 5, '.', p_size, '.', p_partkey % 13, '/collection.xml') path", "p_partkey mtime")
    return catalog.pick_collection(paths, "Deck")


# --- jobs ----------------------------------------------------------------------------------------

_STATE = "state as (select path, arg_max(status, seq) status, arg_max({'e': error}, seq).e error, arg_max(size, seq) size, max(seq) seq from v_jobs group by path)"
_ITEMS = "items as (select concat('/Music/', pos::varchar) path, pos, pos % 3 size from v_files)"


def _items(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "v_files").selectExpr("concat('/Music/', cast(pos as string)) path", "pos", "pos % 3 size")


@query(f"with {_STATE} select path, status, error, size, seq from state")
def job_state_latest(spark, sf_dir):
    """SNK4, SRC11, AG2: the last state of each path."""
    return jobs.latest(view(spark, sf_dir, "v_jobs")).select("path", "status", "error", "size", "seq")


@query(f"with {_STATE}, {_ITEMS} select i.path, coalesce(s.status = 'done' and s.size = i.size, false) done from items i left join state s on i.path = s.path")
def done_current(spark, sf_dir):
    """FLT8, JN5: finished and unchanged since."""
    state = jobs.latest(view(spark, sf_dir, "v_jobs")).withColumn("mtime_ns", F.lit(0))
    return jobs.done_current(_items(spark, sf_dir).withColumn("mtime_ns", F.lit(0)), state).select("path", "done")


@query(f"with {_STATE}, {_ITEMS} select path, pos from items where path not in (select path from state where status = 'done')")
def pending_antijoin(spark, sf_dir):
    """JN4, FLT5, FLT11: what is left to do."""
    ready = jobs.latest(view(spark, sf_dir, "v_jobs")).where("status = 'done'")
    return jobs.pending(_items(spark, sf_dir), ready, "path").select("path", "pos")


@query(f"with {_STATE}, {_ITEMS} select path, pos from items where path in (select path from state where status = 'done')")
def skipped_semijoin(spark, sf_dir):
    """JN4: what is done already."""
    ready = jobs.latest(view(spark, sf_dir, "v_jobs")).where("status = 'done'")
    return jobs.skipped(_items(spark, sf_dir), ready, "path").select("path", "pos")


# --- signals -------------------------------------------------------------------------------------

_GRID = f"""s as (select ch, t, sum(x)::bigint x from v_signal group by ch, t), n as (select max(t) + 1 n from s),
grid as (select unnest(range(0, (select n from n)::bigint, {STRIDE})) o),
cov as (select ch, t, x, o // {STRIDE} chunk, t - o i from s join grid on t >= o and t < o + {LENGTH})"""
_W = f"case when i < {LENGTH // 2} then i + 1 else {LENGTH} - i end"


def _signal(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "v_signal").groupBy("ch", "t").agg(F.sum("x").alias("x"))


@query(f"with {_GRID} select ch, chunk, count(*) n, sum(x)::bigint total, min(t) first_t, max(t) last_t from cov group by ch, chunk")
def chunk_offsets(spark, sf_dir):
    """WN1, JN8: overlapping chunks of a signal."""
    c = signal.chunks(_signal(spark, sf_dir), LENGTH, STRIDE)
    return c.groupBy("ch", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"""with {_GRID}, c as (select *, sum(x) over (partition by ch, chunk) cs from cov)
  select ch, t, sum({_W} * ({LENGTH} * x - cs))::bigint num, sum({_W})::bigint den from c group by ch, t""")
def overlap_add(spark, sf_dir):
    """WN2, AG9, AG13: triangular overlap-add of mean-free chunks."""
    return signal.centred_overlap_add(_signal(spark, sf_dir), ["ch"], LENGTH, STRIDE).select("ch", "t", "num", "den")


@query(f"""with s as (select ch, t, sum(x)::bigint x from v_signal group by ch, t),
sh as (select unnest([0, 5, 11]) shift), m as (select ch, t + 16 - shift t, x, shift from s, sh),
grid as (select unnest(range(0, (select max(t) + 1 from m)::bigint, {STRIDE})) o),
cov as (select ch, shift, t, x, o // {STRIDE} chunk, t - o i from m join grid on t >= o and t < o + {LENGTH}),
c as (select *, sum(x) over (partition by ch, shift, chunk) cs from cov),
o as (select ch, shift, t, sum({_W} * ({LENGTH} * x - cs)) / sum({_W})::double as value from c group by ch, shift, t)
select ch, t - 16 + shift t, round(avg(value), 4) as value from o group by ch, t - 16 + shift""")
def shift_average(spark, sf_dir):
    """WN6, AG11: mean over fixed shifts."""
    out = signal.shift_average(_signal(spark, sf_dir), ["ch"], [0, 5, 11], 16, LENGTH, STRIDE)
    return out.select("ch", "t", F.round("value", 4).alias("value"))


@query("select ch, count(*) n, round(avg(x), 6) mean, round(stddev_pop(x), 6) std from v_signal group by ch")
def normalise_stats(spark, sf_dir):
    """AG10: count, mean and population deviation."""
    s = signal.statistics(view(spark, sf_dir, "v_signal"), ["ch"])
    return s.select("ch", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""with v as (select vec_id // 4 g, vec_id % 4 slot, t, x from v_parts),
m as (select g, t, sum(x) x from v group by g, t),
st as (select g, t, sum(case when g % 3 = 1 and slot = 3 then 0 when g % 3 = 2 then 2 * x else x end) s from v group by g, t),
b as (select m.g, m.t, x, s from m join st on m.g = st.g and m.t = st.t),
a as (select g, sqrt(avg(x*x)) rms, sqrt(avg(s*s)) srms, sum(case when t % 7 = 0 then x*s else 0 end) ab,
  sum(case when t % 7 = 0 then x*x else 0 end) aa, sum(case when t % 7 = 0 then s*s else 0 end) bb from b group by g)
select g, round(srms / rms, 6) ratio, round(ab / (sqrt(aa) * sqrt(bb) + 1e-12), 6) cos,
  case when ab / (sqrt(aa) * sqrt(bb) + 1e-12) < 0.95 or srms / rms < 0.55 or srms / rms > 1.8 then 'failed' else 'passed' end verdict from a""")
def stem_sum_gate(spark, sf_dir):
    """AG5 to AG8: the parts' sum against the master."""
    v = view(spark, sf_dir, "v_parts").selectExpr("vec_id div 4 g", "vec_id % 4 slot", "cast(t as bigint) t", "x")
    master = v.groupBy("g", "t").agg(F.sum("x").alias("x"))
    parts = v.withColumn("x", F.expr("case when g % 3 = 1 and slot = 3 then 0 when g % 3 = 2 then 2 * x else x end"))
    out = signal.gate(master, parts, ["g"], F.col("t"), every=7)
    return out.select("g", F.round("ratio", 6).alias("ratio"), F.round("cos", 6).alias("cos"), "verdict")


@query("""with v as (select vec_id // 4 g, vec_id % 4 slot, t, x * 9 x from v_parts where t < 64 - 8 * (vec_id % 4))
select g, t, """ + ", ".join(
    f"round(greatest(-0.99, least(0.99, coalesce(max(case when slot = {s} then x end), 0.0))), 6) slot{s}" for s in range(4)
) + " from v group by g, t")
def interleave_slots(spark, sf_dir):
    """AG4, SC12 to SC14: slots side by side, padded and clipped."""
    v = view(spark, sf_dir, "v_parts").where("t < 64 - 8 * (vec_id % 4)").selectExpr("vec_id div 4 g", "vec_id % 4 slot", "cast(t as bigint) t", "x * 9 x")
    return signal.interleave(v, ["g"], 4).select("g", "t", *[F.round(f"slot{s}", 6).alias(f"slot{s}") for s in range(4)])


@query("""select id t, cast(trunc(0.15 * 32767 * sin(2 * pi() * 440.0 * id / 44100)) as int) sample
  from (select unnest(range(11025)) id) q""")
def sine_source(spark, sf_dir):
    """SRC10: a quarter second of a 16-bit sine."""
    return wav.sine(spark, 440.0, 0.25, 44100)


_PADDED = """
pos as (select unnest(range(92)) p), frames as (select unnest(range(2, 18)) f), ns as (select unnest(range(16)) n), bins as (select unnest(range(8)) k),
src as (select p, case when q2 < 0 then -q2 when q2 > 63 then 126 - q2 else q2 end t from (
  select p, (case when p - 8 < 0 then 8 - p when p - 8 > 75 then 150 - (p - 8) else p - 8 end) - 6 q2 from pos) r),
pad as (select vec_id, p, x from src join v_parts v on v.t = src.t),
win as (select vec_id, f, n, x * (0.5 - 0.5 * cos(2 * pi() * n / 16)) y from frames, ns, pad where p = 4 * f + n),
z as (select vec_id, f, k, sum(y * cos(2 * pi() * k * n / 16)) / 4 re, -sum(y * sin(2 * pi() * k * n / 16)) / 4 im from win, bins group by vec_id, f, k)"""


def _blocks(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("x"))


@query(f"with {_PADDED.strip()} select vec_id, f - 2 frame, k bin, round(re, 5) + 0.0 re, round(im, 5) + 0.0 im from z")
def stft_small(spark, sf_dir):
    """WN3, SC15 to SC18: transform of short blocks."""
    z = _blocks(spark, sf_dir).select("vec_id", F.posexplode(stft.stft(F.col("x"), 16, 4)).alias("frame", "z"))
    out = z.select("vec_id", F.col("frame").cast("bigint").alias("frame"), F.posexplode(F.arrays_zip("z.re", "z.im")).alias("bin", "v"))
    return out.select("vec_id", "frame", F.col("bin").cast("bigint").alias("bin"), (F.round("v.re", 5) + 0.0).alias("re"), (F.round("v.im", 5) + 0.0).alias("im"))


@query(f"""with {_PADDED.strip()},
inv as (select vec_id, f, n, (max(case when k = 0 then re end) + 2 * sum(case when k > 0 then re * cos(2 * pi() * k * n / 16) - im * sin(2 * pi() * k * n / 16) else 0 end)) / 4
   * (0.5 - 0.5 * cos(2 * pi() * n / 16)) y from z, ns group by vec_id, f, n),
num as (select vec_id, 4 * f + n p, sum(y) y from inv group by vec_id, 4 * f + n),
den as (select 4 * f + n p, sum((0.5 - 0.5 * cos(2 * pi() * n / 16)) ** 2) d from (select unnest(range(20)) f) a, ns group by 4 * f + n)
select vec_id, num.p - 14 t, round(y / greatest(d, 1e-8), 5) + 0.0 x from num join den on num.p = den.p where num.p - 14 between 6 and 57""")
def istft_roundtrip(spark, sf_dir):
    """WN4, AG12: transform and back, inner samples."""
    b = _blocks(spark, sf_dir).withColumn("y", stft.istft(stft.stft(F.col("x"), 16, 4), 16, 4, 64))
    out = b.select("vec_id", F.posexplode("y").alias("t", "v")).where("t between 6 and 57")
    return out.select("vec_id", F.col("t").cast("bigint").alias("t"), (F.round("v", 5) + 0.0).alias("x"))


# --- text and JSON -------------------------------------------------------------------------------


@query(r"""select doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(trim(text, E' \t\n\r'), '[/:\\]+', ' - ', 'g'), '[\x00\r\n\t]+', ' ', 'g'), '\s+', ' ', 'g'), ' .'), ''), 'untitled') name from documents""")
def sanitise_text(spark, sf_dir):
    """SC1: safe file names."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.sanitise(F.col("text")).alias("name"))


@query("""select event_id, case when value < 60 then printf('%.1fs', value) else printf('%dm %02ds', (trunc(value)::bigint) // 60, (trunc(value)::bigint) % 60) end took,
  case when value < 60 then 'yes' else 'no' end short from (select event_id, abs(round(value, 3)) * 7 + 0.0123 as value from events) q""")
def duration_text(spark, sf_dir):
    """SC2, SC3: durations in words."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "abs(round(value, 3)) * 7 + 0.0123 v")
    return e.select("event_id", text.duration(F.col("v")).alias("took"), text.yes_no(F.col("v") < 60).alias("short"))


@query("select doc_id, sha256(nfc_normalize(text)) key from documents")
def nfc_key(spark, sf_dir):
    """PRJ4: canonical composition."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.sha2(text.nfc(F.col("text")), 256).alias("key"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def props_json(spark, sf_dir):
    """SC20: fields of a JSON text."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""select pos, o output_path, 'aac' codec, 256000 bitrate, n slots, 'separator:vocals' last_source, path master from (
  select pos, path, concat('/Outputs/', pos::varchar) o, 5 n from v_files) q""")
def plan_json(spark, sf_dir):
    """SNK11, SNK12, PRJ10: plans written as JSON and read again."""
    v = view(spark, sf_dir, "v_files")
    plan = mp4.plan_json(F.concat(F.lit("/Outputs/"), F.col("pos").cast("string")), F.col("path"), "aac", 256000, 44100, "separator")
    kind = "output string, codec string, bitrate int, sample_rate int, native boolean, streams array<struct<slot:string,path:string,source:string>>"
    p = v.select("pos", F.from_json(plan, kind).alias("p"))
    return p.select(
        "pos",
        F.col("p.output").alias("output_path"),
        "p.codec",
        "p.bitrate",
        F.size("p.streams").alias("slots"),
        F.element_at("p.streams", -1)["source"].alias("last_source"),
        F.element_at("p.streams", 1)["path"].alias("master"),
    )


@query("""select p_partkey pos, n = 5 ok, case when n = 5 then '5 audio streams' else concat('expected 5 audio streams, found ', n::varchar) end message
  from (select p_partkey, p_size % 7 n from part) q""")
def stream_check(spark, sf_dir):
    """FLT6, SRC14, AG14: exactly five audio streams in a probe's JSON."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey pos", "p_size % 7 n")
    one = lambda kind: F.array_repeat(F.lit(f'{{"codec_type":"{kind}"}}'), 1)
    streams = F.concat(one("video"), F.array_repeat(F.lit('{"codec_type":"audio"}'), F.col("n").cast("int")))
    probe = F.concat(F.lit('{"streams":['), F.array_join(streams, ","), F.lit("]}"))
    return p.select("pos", mp4.five_audio_streams(probe).alias("c")).select("pos", "c.ok", "c.message")


@query("""select p_partkey pos, list_filter([case when p_size % 2 = 0 then 'brand is not mp42' end, case when p_size % 3 = 0 then 'metadata is not of version 2' end,
  case when p_size % 5 = 0 then 'a track is off' end], lambda x: x is not null)::varchar failed from part""")
def metadata_check(spark, sf_dir):
    """FLT7, AG15: names of the checks that a description fails."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    info = F.concat(
        F.when(F.col("p_size") % 2 == 0, "").otherwise("Major Brand mp42\n"),
        F.lit("UDTA types:\n\tstem: "),
        F.when(F.col("p_size") % 3 == 0, "{}").otherwise('{"version":2}'),
        F.lit('{"name":"Vocals"}'),
        F.when(F.col("p_size") % 5 == 0, "Disabled In Movie").otherwise(""),
    )
    return p.select(F.col("p_partkey").alias("pos"), F.concat(F.lit("["), F.array_join(mp4.checks(info), ", "), F.lit("]")).alias("failed"))


@query("""select p_partkey pos, case when p_size % 3 = 0 then null when p_size % 3 = 1 then p_size / 5.0 else p_size::double end AS seconds from part""")
def fraction_text(spark, sf_dir):
    """Fractions such as 39/5 in settings."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    s = F.expr("case p_size % 3 when 0 then concat(p_size, '/0') when 1 then concat(p_size, '/5') else cast(p_size as string) end")
    return p.select(F.col("p_partkey").alias("pos"), text.fraction(s).alias("seconds"))


# --- containers ----------------------------------------------------------------------------------


def _containers(spark, sf_dir) -> DataFrame:
    """Small hand-built containers: a header, a movie box with two tracks and media data of varying size."""
    head = mp4.box(b"ftyp", b"mp42\0\0\0\0mp42").hex()
    track = mp4.box(b"trak", mp4.box(b"tkhd", bytes(34) + b"\0\x07" + bytes(48))).hex()
    movie = mp4.box(b"moov", mp4.box(b"mvhd", bytes(100)) + 2 * bytes.fromhex(track) + mp4.box(b"udta", mp4.box(b"name", b"old"))).hex()
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    body = F.repeat(F.lit("74"), F.col("p_size"))
    media = F.concat(F.lpad(F.lower(F.hex((F.col("p_size") + 8).cast("bigint"))), 8, "0"), F.lit(b"mdat".hex()), body)
    return part.select(F.col("p_partkey").alias("pos"), F.col("p_size").alias("media"), F.unhex(F.concat(F.lit(head), F.lit(movie), media)).alias("content"))


@query("""with b as (select p_partkey pos, p_size, unnest([0, 20, 28, 136, 144, 236, 244, 336, 344]) as "offset",
   unnest(['ftyp', 'moov', 'mvhd', 'trak', 'tkhd', 'trak', 'tkhd', 'udta', 'name']) as "type",
   unnest([20, 335, 108, 100, 92, 100, 92, 19, 11]) size, unnest([0, 0, 1, 1, 2, 1, 2, 1, 2]) depth from part)
  select pos, "offset", size, "type", depth from b union all select p_partkey, 355, p_size + 8, 'mdat', 0 from part""")
def mp4_boxes(spark, sf_dir):
    """SC21: the boxes of a container."""
    c = _containers(spark, sf_dir)
    spark.udtf.register("phonolith_boxes", mp4.BoxList)
    out = spark.sql("select pos, b.offset, b.size, b.type, b.depth from {c} c, lateral phonolith_boxes(c.content) b", c=c)
    return out.select("pos", F.col("offset"), "size", "type", "depth")


@query("""select p_partkey pos, 355 + p_size + 8 - 19 + 16 + length(m)::bigint size, 1 metadata_boxes, 0 old_names, 0 alternate_groups
  from part, (select '""" + mp4.metadata_json() + "' m) q")
def mp4_inject(spark, sf_dir):
    """SNK2, SNK3: metadata put into the movie box in place of old user data."""
    c = _containers(spark, sf_dir).withColumn("new", mp4.injected(F.col("content"), F.lit(mp4.metadata_json())))
    hexed = F.hex("new")
    count = lambda s: ((F.length(hexed) - F.length(F.replace(hexed, F.lit(s), F.lit("")))) / len(s)).cast("int")
    return c.select(
        "pos",
        F.length("new").cast("bigint").alias("size"),
        count(b"stem{".hex().upper()).alias("metadata_boxes"),
        count(b"name\0old".hex().upper()).alias("old_names"),
        count("0007" + "00" * 8).alias("alternate_groups"),
    )


# --- real files ----------------------------------------------------------------------------------


_SUFFIX = "case s_suppkey % 9 when 0 then 'flac' when 1 then 'WAV' when 2 then 'aiff' when 3 then 'aif' when 4 then 'mp3' when 5 then 'm4a' when 6 then 'alac' when 7 then 'txt' else 'wav.part' end"


def _suppliers(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet")


def _below(root: str):
    """A path without the folder it was written to."""
    return F.regexp_replace("path", F.lit("^" + root.removeprefix("file://").rstrip("/") + "/"), F.lit(""))


@query(f"""select concat(s_nationkey::varchar, '/', s_suppkey::varchar, ' - ', s_name, '.', {_SUFFIX}) path, (10 + s_suppkey % 50)::bigint size
  from supplier where s_suppkey % 9 < 7""")
def scan_files(spark, sf_dir):
    """SRC1, FLT1: files written to folders and scanned again; only audio suffixes, in any case, count."""
    root = scratch.folder(spark, "scan")
    name = F.expr(f"concat(s_nationkey, '/', s_suppkey, ' - ', s_name, '.', {_SUFFIX})")
    scratch.write_files(_suppliers(spark, sf_dir).select(name.alias("name"), F.expr("cast(repeat('x', cast(10 + s_suppkey % 50 as int)) as binary)").alias("content")), root)
    return files.scan(spark, root).select(_below(root).alias("path"), "size")


@query("""select s_suppkey id, case s_suppkey % 5 when 3 then 1 else 2 end channels, case when s_suppkey % 5 = 4 then 1 else 2 end sample_width,
  (8000 + s_suppkey % 3)::int sample_rate, (100 + s_suppkey % 50)::bigint frames from supplier""")
def wav_headers(spark, sf_dir):
    """SRC9: headers of WAV files that were written before."""
    root = scratch.folder(spark, "wav")
    scratch.write_files(_wavs(_suppliers(spark, sf_dir)), root)
    return files.wav_info(spark, root).select(_below(root).alias("name"), "*").selectExpr("cast(replace(name, '.wav', '') as bigint) id", "channels", "sample_width", "sample_rate", "frames")


def _wavs(suppliers: DataFrame) -> DataFrame:
    """(name, content): the samples count up from the supplier's key; mono for each fifth, 8 bits for another fifth."""
    header = lambda n, ch, width, rate: F.concat(
        F.lit("RIFF".encode().hex()), _le(36 + n, 4), F.lit(b"WAVEfmt ".hex()), _le(F.lit(16), 4), _le(F.lit(1), 2), _le(ch, 2), _le(rate, 4), _le(rate * ch * width, 4), _le(ch * width, 2), _le(width * 8, 2), F.lit(b"data".hex()), _le(n, 4)
    )
    k = F.col("s_suppkey")
    ch = F.when(k % 5 == 3, 1).otherwise(2)
    width = F.when(k % 5 == 4, 1).otherwise(2)
    total = (F.lit(100) + k % 50) * ch
    samples = F.array_join(F.transform(F.sequence(F.lit(0), total - 1), lambda i: F.when(width == 1, _le((k + i) % 100, 1)).otherwise(_le((k + i) * 2 % 1000, 2))), "")
    return suppliers.select(
        F.concat(k.cast("string"), F.lit(".wav")).alias("name"),
        F.unhex(F.concat(header(total * width, ch, width, (F.lit(8000) + k % 3)), samples)).alias("content"),
    )


def _le(n, size: int):
    """A number's bytes, the least first, as hexadecimal digits."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("bigint"), 8 * b).bitwiseAND(F.lit(255))), 2, "0") for b in range(size)])


@query("""with s as (select s_suppkey k, case when s_suppkey % 5 = 3 then 1 else 2 end ch, case when s_suppkey % 5 = 4 then 1 else 2 end width, 100 + s_suppkey % 50 n from supplier),
  x as (select k, c, t, case when width = 1 then ((k + t * ch + least(c, ch - 1)) % 100 - 128) / 128.0 else ((k + t * ch + least(c, ch - 1)) * 2 % 1000) / 32768.0 end v
    from (select *, unnest(range(0, n)) t from s) q, (select unnest([0, 1]) c) r)
  select k id, c::int channel, t // 64 block, count(*) n, round(sum(v), 4) total from x group by k, c, t // 64
  union all select -1, 0, -1, 0, null""")
def wav_samples(spark, sf_dir):
    """SRC8: samples of files of several forms in stereo blocks; a broken file is a row of its own."""
    root = scratch.folder(spark, "wav")
    broken = spark.createDataFrame([("-1.wav", b"RIFF no wav")], "name string, content binary")
    scratch.write_files(_wavs(_suppliers(spark, sf_dir)).unionByName(broken), root)
    rows = wav.decoded(files.contents(spark, root), 64).withColumn("name", _below(root))
    return rows.selectExpr("cast(replace(name, '.wav', '') as bigint) id", "channel", "block", "cast(coalesce(array_size(samples), 0) as bigint) n", "round(aggregate(samples, 0D, (a, v) -> a + v), 4) total")


_XML = r"""x as (select * from v_collection), kept as (
  select concat(regexp_replace(replace(replace(dir_value, '/:', '/'), ':', ''), '/+$', ''), '/', file_value) path, nullif(title, '') title, artist, audio_id, flags from x where pos % 10 <> 0)"""


@query(f"with {_XML} select path, title, artist, audio_id, flags from kept")
def xml_collection(spark, sf_dir):
    """SRC3, FLT2, PRJ3: a collection written as XML and read again; entries without a place do not count."""
    v = view(spark, sf_dir, "v_collection")
    place = F.struct(F.col("dir_value").alias("_DIR"), F.when(F.col("pos") % 20 == 0, F.lit(None)).otherwise(F.col("file_value")).alias("_FILE"), F.lit("v").alias("_VOLUME"))
    rows = v.select(
        F.col("audio_id").alias("_AUDIO_ID"),
        F.col("title").alias("_TITLE"),
        F.col("artist").alias("_ARTIST"),
        F.when(F.col("pos") % 20 != 10, place).alias("LOCATION"),
        F.when(F.col("flags").isNotNull(), F.struct(F.col("flags").cast("string").alias("_FLAGS"))).alias("INFO"),
    )
    root = scratch.folder(spark, "xml")
    rows.write.format("xml").option("rowTag", "ENTRY").option("rootTag", "COLLECTION").save(root)
    return collection.read(spark, root).withColumn("title", text.full(F.col("title")))


@query("""select n_nationkey id, case when n_nationkey % 3 = 0 then n_regionkey | 64 else n_regionkey end flags,
  (select count(*) from nation where n_nationkey % 3 = 0 and (n_regionkey & 64) = 0) changed, 1 missing, 'collection.nml.bak,collection.nml.bak1' backups from nation""")
def collection_update(spark, sf_dir):
    """SNK6, SNK8, SNK9, JN6: a collection file marked, backed up twice, written whole and read again.

    The file and its exact update are the driver's work, one entry for each nation.
    """
    import os
    import tempfile
    from xml.sax.saxutils import quoteattr

    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "collection.nml")
        rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows
        entries = "".join(f'<ENTRY AUDIO_ID="{r["n_nationkey"]:04}" TITLE={quoteattr(r["n_name"])}><LOCATION DIR="/:M/:" FILE="{r["n_nationkey"]}.wav"/><INFO FLAGS="{r["n_regionkey"]}"/></ENTRY>' for r in rows)
        with open(path, "w", encoding="utf-8") as f:
            f.write(f"<NML><COLLECTION>{entries}</COLLECTION></NML>")
        file = collection.CollectionFile(path)
        changed, missing = file.mark([f"/M/{r['n_nationkey']}.wav" for r in rows if r["n_nationkey"] % 3 == 0] + ["/M/none.wav"])
        backups = ",".join(file.backup().name for _ in range(2))
        file.write()
        read = [tuple(r) for r in collection.read_ordered(spark, f"file://{path}").selectExpr("cast(audio_id as int) id", "flags").collect()]
    out = spark.createDataFrame(read, "id int, flags int")
    return out.select("id", "flags", F.lit(changed).cast("bigint").alias("changed"), F.lit(len(missing)).alias("missing"), F.lit(backups).alias("backups"))


@query("""select row_number() over (order by event_id) - 1 line_no, 'T' || user_id::varchar title, '/Outputs/' || event_id::varchar path, '0us' as "offset"
  from events qualify event_type = 'purchase'""")
def log_file(spark, sf_dir):
    """SRC4, SRC5, FLT3: a log written beside a collection, with lines of other kinds, and read again."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    stored = F.expr("""concat('2024 - Finished stem separation job for track "T', user_id, '" - result: successful: stem file stored to "/Outputs/', event_id, '", with offset 0us, elapsed')""")
    place = logs.log_path(scratch.folder(spark, "log") + "/collection.nml", "Deck")
    e.orderBy("event_id").select(F.when(F.col("event_type") == "purchase", stored).otherwise("other").alias("value")).coalesce(1).write.text(place)
    return logs.entries(logs.lines(spark, place))


@query("""select p_partkey id, p_name as name, p_retailprice price, p_size % 2 = 0 even from part""")
def json_files(spark, sf_dir):
    """SNK13: rows written as JSON lines and read again."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey id", "p_name name", "p_retailprice price", "p_size % 2 = 0 even")
    root = scratch.folder(spark, "json")
    rows.write.json(root)
    return spark.read.schema(rows.schema).json(root)


# --- lookups and shapes --------------------------------------------------------------------------


@query(rf"""with {_ENTRIES.strip()}, f as (select path, regexp_extract(path, '([^/]*)$', 1) nm from v_files),
  b as (select *, regexp_replace(nm, '\.[^.]+$', '') bare0 from f),
  p as (select *, trim(regexp_replace(bare0, '^\s*\d+\s*-\s*', '')) bare from b),
  q as (select *, list_filter(list_transform(string_split(bare, ' - '), lambda x: trim(x)), lambda x: x <> '') parts from p)
  select path, case when key is not null then coalesce(nullif(e.t, ''), bare0) when len(parts) >= 2 then array_to_string(parts[2:], ' - ') when bare <> '' then bare else bare0 end title,
    case when key is not null then e.a when len(parts) >= 2 then parts[1] end artist, e.i audio_id
  from q left join found on nfc_normalize(path) = key""")
def single_tracks(spark, sf_dir):
    """PRJ6, JN2: named files looked up one by one: the bare stem stands for an empty title, no artist for a missing one."""
    index = catalog.collection_index(_collection(spark, sf_dir))
    return catalog.single_tracks(view(spark, sf_dir, "v_files").select("path"), index)


_ALIAS = "case when pos % 5 = 0 then replace(path, '/Music/', '/Link/') else path end"


@query(f"""with {_SCAN.strip()}, en as (
  select pos, {_ALIAS} path, path resolved, title, artist, audio_id from (
    select pos, concat(regexp_replace(replace(replace(dir_value, '/:', '/'), ':', ''), '/+$', ''), '/', file_value) path, title, artist, audio_id from v_collection) c),
  keyed as (select nfc_normalize(path) key, * from en union select nfc_normalize(resolved), * from en),
  found as (select key, arg_max({{'t': title, 'a': artist, 'i': audio_id}}, pos) e from keyed group by key),
  asked as (select pos, case when pos % 7 = 0 then replace(path, '/Music/', '/Other/') else path end path, path resolved, title, artist from scanned)
  select a.pos, coalesce(nullif(coalesce(x.e, y.e).t, ''), title) title, coalesce(nullif(coalesce(x.e, y.e).a, ''), artist) artist, coalesce(x.e, y.e).i audio_id
  from asked a left join found x on nfc_normalize(a.path) = x.key left join found y on nfc_normalize(a.resolved) = y.key""")
def resolved_lookup(spark, sf_dir):
    """JN1a, JN1b: entries with two keys; a file asks with its resolved path where its own finds nothing."""
    entries = _collection(spark, sf_dir).withColumn("resolved", F.col("path")).withColumn("path", F.expr(_ALIAS))
    index = catalog.collection_index(entries.select("pos", "path", "resolved", "title", "artist", "audio_id", "flags"), "resolved")
    asked = _scanned(spark, sf_dir).withColumn("resolved", F.col("path")).withColumn("path", F.expr("case when pos % 7 = 0 then replace(path, '/Music/', '/Other/') else path end"))
    return catalog.enrich_resolved(asked, index).select("pos", "title", "artist", "audio_id")


@query("""select vec_id, case s when 0 then 'drums' when 1 then 'bass' when 2 then 'other' else 'vocals' end slot, round(sum(x * [0.4, 0.3, 0.2, 0.1][s + 1]), 5) + 0.0 total
  from v_parts, (select unnest(range(4)) s) q group by vec_id, s""")
def slot_names(spark, sf_dir):
    """MD1's stand-in, MD5, PRJ8, JN7, WN5: blocks through a separator in batches of seven, parts named by place."""
    chunks = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("samples"))
    parts = separate.named(separate.separate(chunks, "linear-stand-in", 70, batch=7))
    return parts.select("vec_id", "slot", (F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 5) + 0.0).alias("total"))


@query("""select vec_id // 8 track, vec_id % 2 channel, (vec_id % 8) // 2 block, s slot, round(sum(x * [0.4, 0.3, 0.2, 0.1][s + 1]), 5) + 0.0 total
  from v_parts, (select unnest(range(4)) s) q group by 1, 2, 3, 4""")
def block_overlap_add(spark, sf_dir):
    """WN1, WN2, MD4, AG9: chunks of blocks, separated and added up again; equal parts of a signal give the signal back."""
    blocks = _track_blocks(spark, sf_dir)
    parts = process.reassembled(separate.separate(process.chunked(blocks, 96, 64), "linear-stand-in", 96), 96, 64)
    return parts.selectExpr("cast(path as bigint) track", "channel", "block", "slot", "round(aggregate(samples, 0D, (a, v) -> a + v), 5) + 0.0 total")


def _track_blocks(spark, sf_dir) -> DataFrame:
    """Eight vectors make a track: four blocks of 64 samples in each of two channels."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.selectExpr("cast(vec_id div 8 as string) path", "1000 sample_rate", "cast(vec_id % 2 as int) channel", "cast((vec_id % 8) div 2 as bigint) block", "transform(embedding, v -> cast(v as double)) samples")


@query("""with x as (select vec_id // 8 g, case when (vec_id // 8) % 4 = 0 then 0 else x end x, case (vec_id // 8) % 4 when 1 then 0.4 when 2 then 2.0 else 1.0 end f from v_parts),
  s as (select g, sqrt(avg(x * x)) rms, sqrt(avg(x * f * x * f)) srms from x group by g)
  select g track, case when rms < 1e-5 then null else round(srms / rms, 5) end ratio, case when rms < 1e-5 then 'silent' when srms / rms < 0.55 or srms / rms > 1.8 then 'failed' else 'passed' end verdict from s""")
def block_gate(spark, sf_dir):
    """MD4, AG5 to AG8: the parts' sum against the master, block by block, with silent, weak and loud tracks."""
    blocks = _track_blocks(spark, sf_dir)
    turn = "cast(path as bigint) % 4"
    blocks = blocks.withColumn("samples", F.expr(f"transform(samples, v -> case when {turn} = 0 then 0D else v end)"))
    parts = blocks.withColumn("samples", F.expr(f"transform(samples, v -> v * case {turn} when 1 then 0.2D when 2 then 1D else 0.5D end)"))
    both = parts.withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1))))
    return process.checked(blocks, both, 64, every=1).selectExpr("cast(path as bigint) track", "round(ratio, 5) ratio", "verdict")


_SHAPED = """m as (select vec_id, vec_id % 4 k, list_transform(embedding, lambda v: greatest(-0.99, least(0.99, v::double * 9))) e from embeddings),
ch as (select vec_id, k, e, case k when 0 then e[1:32] when 1 then list_transform(range(32), lambda i: e[2 * i + 1]) when 2 then e else list_transform(range(16), lambda i: e[4 * i + 1]) end l,
  case k when 0 then e[33:64] when 1 then list_transform(range(32), lambda i: e[2 * i + 2]) when 2 then e else list_transform(range(16), lambda i: e[4 * i + 2]) end r from m)"""


def _shaped(spark, sf_dir) -> DataFrame:
    """The vectors as two channels of 32 frames, 32 frames of two, 64 of one or 16 of four."""
    e = F.transform("embedding", lambda v: v.cast("double") * 9)
    cut = lambda n, size: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(e, i * size + 1, size))
    k = F.col("vec_id") % 4
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select("vec_id", audio.stereo(F.when(k == 0, cut(2, 32)).when(k == 1, cut(32, 2)).when(k == 2, cut(64, 1)).otherwise(cut(16, 4))).alias("x"))


def _sum(frames, channel: int):
    return F.round(F.aggregate(frames, F.lit(0.0), lambda a, f: a + f[channel]), 5) + 0.0


@query(f"with {_SHAPED} select vec_id, len(l) frames, round(list_sum(l), 5) + 0.0 left_sum, round(list_sum(r), 5) + 0.0 right_sum from ch")
def stereo_shapes(spark, sf_dir):
    """SC12: signals of several shapes as clipped stereo frames."""
    return _shaped(spark, sf_dir).select("vec_id", F.size("x").cast("bigint").alias("frames"), _sum(F.col("x"), 0).alias("left_sum"), _sum(F.col("x"), 1).alias("right_sum"))


@query(f"""with {_SHAPED} select vec_id // 4 g, max(len(l)) over (partition by vec_id // 4) frames, k slot, round(list_sum(l), 5) + 0.0 left_sum, round(list_sum(r), 5) + 0.0 right_sum
  from ch qualify count(*) over (partition by vec_id // 4) = 4""")
def stacked_slots(spark, sf_dir):
    """SC13, AG4: the signals of a group stacked, the shorter ones filled up with silence."""
    group = _shaped(spark, sf_dir).groupBy((F.floor(F.col("vec_id") / 4)).alias("g")).agg(*[F.max(F.when(F.col("vec_id") % 4 == k, F.col("x"))).alias(f"s{k}") for k in range(4)])
    whole = group.select("g", audio.stacked([F.col(f"s{k}") for k in range(4)]).alias("x")).where("x is not null")
    each = whole.select("g", F.posexplode("x").alias("slot", "y"))
    return each.select("g", F.size("y").cast("bigint").alias("frames"), F.col("slot").cast("bigint").alias("slot"), _sum(F.col("y"), 0).alias("left_sum"), _sum(F.col("y"), 1).alias("right_sum"))


@query("""select vec_id, 64 - vec_id % 7 length, round(list_sum(list_transform(embedding, lambda v: v::double)[1 + (vec_id % 7) // 2 : 64 - (vec_id % 7 - (vec_id % 7) // 2)]), 5) + 0.0 total from embeddings""")
def centre_trim(spark, sf_dir):
    """SC19: the middle of a signal."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("length", 64 - F.col("vec_id") % 7)
    x = audio.centred(F.transform("embedding", lambda e: e.cast("double")), F.col("length").cast("int"))
    return v.select("vec_id", "length", (F.round(F.aggregate(x, F.lit(0.0), lambda a, e: a + e), 5) + 0.0).alias("total"))


@query(f"with {_PADDED.strip()} select vec_id, f - 2 frame, round(sum(sqrt(re * re + im * im)), 4) total, true same from z group by vec_id, f")
def stft_channels(spark, sf_dir):
    """SC18: magnitudes, and complex bins as real channels and back."""
    z = _blocks(spark, sf_dir).select("vec_id", F.posexplode(stft.stft(F.col("x"), 16, 4)).alias("frame", "z"))
    back = stft.from_channels(stft.as_channels(F.array("z", "z")))
    same = (back[0]["re"] == F.col("z.re")) & (back[1]["im"] == F.col("z.im")) & (F.size(back) == 2)
    total = F.aggregate(stft.magnitude(F.col("z")), F.lit(0.0), lambda a, m: a + m)
    return z.select("vec_id", F.col("frame").cast("bigint").alias("frame"), F.round(total, 4).alias("total"), same.alias("same"))


@query("""with s as (select ch, sum(x) x, t from v_signal group by ch, t), m as (select ch, avg(x) mean, stddev_pop(x) std from s group by ch)
  select s.ch, t, round((x - mean) / (1e-5 + std), 5) + 0.0 y from s join m on s.ch = m.ch""")
def normalised(spark, sf_dir):
    """AG10: each sample less its channel's mean, over its deviation."""
    out = signal.normalise(_signal(spark, sf_dir).withColumn("x", F.col("x").cast("double")), ["ch"])
    return out.select("ch", "t", (F.round("y", 5) + 0.0).alias("y"))
