"""Stand-in inputs: file list, collection, log, job history and signals derived from the synthetic tables.

The same SQL text runs in Spark and in DuckDB, but for the audio id and the
array expansion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EXT = (
    "case p_partkey % 9 when 0 then 'flac' when 1 then 'WAV' when 2 then 'aiff' when 3 then 'aif' "
    "when 4 then 'mp3' when 5 then 'm4a' when 6 then 'alac' when 7 then 'txt' else 'jpg' end"
)
_NAME = f"concat(lpad(cast(p_partkey as varchar(20)),6,'0'), ' - ', case when p_partkey % 5 = 0 then '' else concat(p_type,' - ') end, p_name, '.', {_EXT})"
_ID = {
    "spark": "replace(base64(encode(repeat(md5(encode(cast(p_partkey as string),'utf-8')),8),'utf-8')), '\\r\\n', '')",
    "duckdb": "to_base64(encode(repeat(md5(cast(p_partkey as varchar)),8)))",
}


def _collection(engine: str) -> str:
    one = f"""select 4 * p_partkey + p_partkey % 2 pos, concat('/:Music/:DJ/:', replace(p_brand,'#',' '), '/:') dir_value, {_NAME} file_value,
      case when p_partkey % 4 = 0 then '' when p_partkey % 4 = 1 then null else upper(p_name) end title,
      case when p_partkey % 7 = 0 then null else p_type end artist, {_ID[engine]} audio_id,
      case when p_partkey % 6 = 0 then null else p_size end flags
      from part where p_partkey % 3 <> 2"""
    # Every eleventh entry stands twice; the later one counts. Positions keep the key's parity and never meet.
    return f"""{one} union all select pos + 2, dir_value, file_value, concat('Again ', coalesce(title, '')), artist, audio_id, flags
      from ({one}) twice where floor(pos / 4) % 11 = 0"""


def views(engine: str) -> dict[str, tuple[str, str]]:
    """{view: (table it reads, SQL)} for ``spark`` or ``duckdb``."""
    parts = {
        "spark": "select vec_id, p t, cast(e as double) x from embeddings lateral view posexplode(embedding) q as p,e",
        "duckdb": "select vec_id, i-1 t, cast(embedding[i] as double) x from (select vec_id, embedding, unnest(range(1,65)) i from embeddings) q",
    }
    return {
        "v_files": ("part", f"select concat('/Music/DJ/', replace(p_brand,'#',' '), '/', {_NAME}) path, p_partkey pos, p_size*1000 size from part"),
        "v_collection": ("part", _collection(engine)),
        "v_log": (
            "events",
            """select event_id line_no, case when event_type in ('purchase','signup') then
            concat('2024-01-01 - Finished stem separation job for track "T', cast(user_id as varchar(20)),
            '" - result: successful: stem file stored to "', case when event_type='purchase' then '/Outputs/' else '/Other/' end,
            lpad(cast(event_id % 128 as varchar(20)),3,'0'), '/', cast(event_id as varchar(20)),
            '.stem.mp4", with offset 0us, elapsed time: 0m 1s')
            else concat('noise ', event_type) end line from events""",
        ),
        "v_jobs": (
            "events",
            """select event_id seq, concat('/Music/', cast(user_id as varchar(20))) path,
            case event_type when 'purchase' then 'done' when 'error' then 'error' when 'click' then 'running' else 'pending' end status,
            case when event_type='error' then concat('e', cast(event_id as varchar(20))) end error, event_id % 3 size from events""",
        ),
        "v_signal": ("events", "select event_id % 2 ch, cast(floor(event_id/2) as bigint) t, cast(round(value*100) as bigint) x from events"),
        "v_parts": ("embeddings", parts[engine]),
    }


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = views("spark")[name]
    return spark.sql(sql.replace(f"from {table}", "from {" + table + "}"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def oracle(sql: str) -> str:
    """DuckDB SQL with the views it names in front."""
    used = [f"{n} as ({s})" for n, (_, s) in views("duckdb").items() if n in sql]
    body = sql.strip()
    if not used:
        return body
    own = body.removeprefix("with ")
    return "with recursive " + ",\n".join(used) + (",\n" if own != body else "\n") + own
