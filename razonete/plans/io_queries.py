"""Registered queries for the I/O operators.

These write to a fresh folder under the shared checkpoint directory and read
the result back, so the check exercises the real sinks and sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import validate as V
from ..operators.query import Filters, ledger_filter
from ..schema import FILE_COL, KEYS, LEDGER_COLUMNS, LEDGER_SCHEMA, RAW_COLUMNS
from ..session import scratch_path
from ..sources import files
from ..sources.store import LedgerStore, append_table, evolve
from . import fixtures as fx
from . import oracle as O
from .catalog import AS_OF, AS_OF_SQL, DELTA, F_DELETE, LED, ORACLE, RAW, RAWO, _sql_filters, error_lines_sql, register

_LED_NO_NEW = ", ".join(c if c not in ("RATEIO", "ORIGEM") else f"CAST(NULL AS VARCHAR) AS {c}" for c in LEDGER_COLUMNS)


@register("ledger_scan", f"SELECT * FROM {LED}")
def q_ledger_scan(spark, sf):
    """The ledger written through the snapshot store and scanned back."""
    store = LedgerStore(spark, scratch_path(spark, "ledger"))
    store.replace_all(fx.led(spark, sf), lote="carga-inicial", as_of=AS_OF)
    return store.read()


@register("ledger_merge_commit", f"""
SELECT * FROM {LED} t WHERE NOT EXISTS (SELECT 1 FROM {DELTA} s WHERE s.N_CONTA = t.N_CONTA
  AND s.N_CENTRO_CUSTO = t.N_CENTRO_CUSTO AND s.DATA = t.DATA AND s.VERSAO = t.VERSAO)
UNION ALL
SELECT N_CONTA, N_CENTRO_CUSTO, DESCRICAO, VALOR, DATA, VERSAO, OPERACAO, TIMESTAMP '2025-01-15 09:30:00',
       FILIAL, RATEIO, ORIGEM FROM {DELTA}
""")
def q_ledger_merge_commit(spark, sf):
    """U5 committed through the store: only the batch's versions are rewritten."""
    from ..operators.merge import merge_upsert

    store = LedgerStore(spark, scratch_path(spark, "ledger"))
    store.replace_all(fx.led(spark, sf), lote="carga-inicial", as_of=AS_OF)
    batch = fx.delta(spark, sf)
    versions = [r.VERSAO for r in batch.select("VERSAO").distinct().collect()]
    merged = merge_upsert(store.read(versions), batch, as_of=AS_OF)
    store.commit(merged, touched=versions, lote="delta", as_of=AS_OF)
    return store.read()


F_LOOKUP = Filters(n_conta="10007919", data_inicio="1995-01-01", data_fim="1996-12-31")


@register("filter_eq_stored", f"SELECT * FROM {LED} WHERE {_sql_filters(F_LOOKUP)}")
def q_filter_eq_stored(spark, sf):
    """Q1a + Q1b over the stored ledger: one account in a date range, by the statistics and Bloom filters of its files."""
    store = LedgerStore(spark, scratch_path(spark, "ledger"))
    store.replace_all(fx.led(spark, sf), lote="carga-inicial", as_of=AS_OF)
    return ledger_filter(store.read(), F_LOOKUP)


_OLD_MERGED = f"""(SELECT * FROM (SELECT {_LED_NO_NEW} FROM {LED}) t WHERE NOT EXISTS (SELECT 1 FROM {DELTA} s
  WHERE s.N_CONTA = t.N_CONTA AND s.N_CENTRO_CUSTO = t.N_CENTRO_CUSTO AND s.DATA = t.DATA AND s.VERSAO = t.VERSAO)
UNION ALL SELECT {', '.join(f"{AS_OF_SQL} AS {c}" if c == 'DATA_ATUALIZACAO' else c for c in LEDGER_COLUMNS)} FROM {DELTA})"""


def _evolved(spark, sf):
    """A ledger stored with nine columns, merged with a batch of eleven: the versions left alone keep their files."""
    from ..operators.merge import merge_upsert

    root = scratch_path(spark, "ledger")
    old = LedgerStore(spark, root, T.StructType([f for f in LEDGER_SCHEMA.fields if f.name not in ("RATEIO", "ORIGEM")]))
    old.replace_all(fx.led(spark, sf), lote="carga-inicial", as_of=AS_OF)
    store, batch = LedgerStore(spark, root), fx.delta(spark, sf)
    versions = [r.VERSAO for r in batch.select("VERSAO").distinct().collect()]
    store.commit(merge_upsert(store.read(versions), batch, as_of=AS_OF), touched=versions, lote="delta", as_of=AS_OF)
    return store


@register("ledger_evolve_commit", f"SELECT * FROM {_OLD_MERGED}")
def q_ledger_evolve_commit(spark, sf):
    """S10 in the store: files of nine and of eleven columns, read as one ledger after a merge."""
    return _evolved(spark, sf).read()


@register("ledger_evolve_edit", ORACLE["apply_edits"].replace(f"FROM {LED} t", f"FROM {_OLD_MERGED} t"))
def q_ledger_evolve_edit(spark, sf):
    """S10 in the store: the edit set committed over a ledger of nine and eleven columns."""
    from ..operators.audit import AuditContext
    from ..sources.store import AuditLog
    from .maintenance import edit_records

    store = _evolved(spark, sf)
    edit_records(store, AuditLog(spark, scratch_path(spark, "audit")), fx.edits(spark, sf), AuditContext(as_of=AS_OF))
    return store.read()


@register("table_append", f"SELECT * FROM {LED} UNION ALL SELECT * FROM {DELTA}")
def q_table_append(spark, sf):
    path = scratch_path(spark, "append")
    append_table(fx.led(spark, sf), path)
    append_table(fx.delta(spark, sf), path)
    return spark.read.parquet(path).select(*LEDGER_COLUMNS)


@register("schema_evolve", f"SELECT {_LED_NO_NEW} FROM {LED} UNION ALL SELECT * FROM {DELTA}")
def q_schema_evolve(spark, sf):
    path = scratch_path(spark, "old_ledger")
    fx.led(spark, sf).drop("RATEIO", "ORIGEM").write.parquet(path)
    return evolve(spark.read.parquet(path), fx.delta(spark, sf))


@register("scan_csv", f"SELECT * FROM {RAW}")
def q_scan_csv(spark, sf):
    """Raw lines written as CSV with a header and read back as text."""
    path = scratch_path(spark, "csv")
    files.write_csv(fx.raw(spark, sf), path)
    return files.drop_helpers(files.read_csv_batch(spark, path)).select(*RAW_COLUMNS, FILE_COL)


# the lots as CSV files with blank lines and quoted line breaks; every line's physical place in its file
_CSV_TEXT = fx.csv_text_sql(RAW, RAW_COLUMNS).replace("CAST(ORDEM AS STRING)", "CAST(ORDEM AS VARCHAR)")
_CSV_LINES = f"""
SELECT *, CAST(1 + EM_BRANCO + ORDEM + coalesce(sum(EM_BRANCO + QUEBRAS)
  OVER (PARTITION BY ARQUIVO ORDER BY ORDEM ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS LINHA
FROM ({_CSV_TEXT})"""
_CSV_DESCRICAO = """CASE WHEN ORDEM % 7 = 3 THEN coalesce(DESCRICAO, '') || chr(10) || ', "x",' || chr(10) || 'fim'
  WHEN ORDEM % 11 = 4 THEN coalesce(DESCRICAO, '') || chr(10) || ', "x",' ELSE nullif(DESCRICAO, '') END"""
_CSV_RAW = f"""(SELECT ARQUIVO, n.LINHA, CAST(ORDEM AS VARCHAR) AS ORDEM, {', '.join(f"nullif({c}, '') AS {c}" if c != 'DESCRICAO' else f'{_CSV_DESCRICAO} AS DESCRICAO' for c in RAW_COLUMNS)}
  FROM (SELECT *, row_number() OVER (PARTITION BY ARQUIVO ORDER BY {', '.join(f'{c} NULLS FIRST' for c in RAW_COLUMNS)}) AS ORDEM FROM {RAW}) r
  JOIN (SELECT ARQUIVO, ORDEM, LINHA FROM ({_CSV_LINES})) n USING (ARQUIVO, ORDEM))"""


_NO_LOT = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name for a null; a lot that is never null keeps the order below


def _land_csv(spark, sf, path):
    """The lots as CSV files under ARQUIVO=<lot>/, a header and then every line in its order.

    The window that numbers a lot's lines leaves them dealt and sorted by lot, as the writer wants them: one exchange, one sort.
    """
    raw = fx.raw(spark, sf).withColumn(FILE_COL, F.coalesce(FILE_COL, F.lit(_NO_LOT)))
    head = ",".join([*RAW_COLUMNS, "Número da linha"])
    text = spark.sql(fx.csv_text_sql("{raw}", RAW_COLUMNS), raw=raw)
    line = F.when(F.col("ORDEM") == 1, F.concat(F.lit(f"{head}\n"), "TEXTO")).otherwise(F.col("TEXTO"))
    text.select(FILE_COL, line.alias("TEXTO")).write.partitionBy(FILE_COL).text(path)


def _read_landed(spark, path, **how):
    rows = files.read_csv_files(spark, path, glob="*.txt", **how)
    return rows.withColumn(FILE_COL, F.regexp_extract("_file", f"{FILE_COL}=([^/]+)/", 1))


@register("error_lines_csv", error_lines_sql(f"SELECT * FROM {_CSV_RAW}"))
def q_error_lines_csv(spark, sf):
    """S5 + G3 on real files: blank lines and quoted line breaks count, files are read in many splits."""
    path = scratch_path(spark, "csv")
    _land_csv(spark, sf, path)
    return V.error_lines(V.apply_rules(_read_landed(spark, path)))


@register("scan_csv_extras", f"""
SELECT ARQUIVO, LINHA, {', '.join(RAW_COLUMNS)}, 'NUMERO_DA_LINHA=' || ORDEM AS EXTRAS FROM {_CSV_RAW}""")
def q_scan_csv_extras(spark, sf):
    """S1 with a column that the layout does not know: it comes back in the map of extras, with its line."""
    path = scratch_path(spark, "csv")
    _land_csv(spark, sf, path)
    extras = F.concat_ws(";", F.transform(F.map_entries(files.EXTRAS_COL), lambda e: F.concat(e.key, F.lit("="), e.value)))
    return _read_landed(spark, path, extras=True).select(FILE_COL, "LINHA", *RAW_COLUMNS, extras.alias("EXTRAS"))


LANDED_LOT = "LOTE"   # the column of a landed file that names a line's lot
LANDING_FILES = 16    # landed files, at least: more than one micro-batch

_STREAM_SQL = f"""
WITH v AS ({O.validated_sql(RAWO)}),
bad AS (SELECT ARQUIVO FROM v GROUP BY ARQUIVO
        HAVING max(CASE WHEN N_ERROS > 0 OR length(coalesce(N_CENTRO_CUSTO, '')) <> 9 THEN 1 ELSE 0 END) = 1)
SELECT coalesce(N_CONTA, '') AS N_CONTA, coalesce(N_CENTRO_CUSTO, '') AS N_CENTRO_CUSTO,
  coalesce(DESCRICAO, '') AS DESCRICAO, coalesce(VALOR, 0.0) AS VALOR, DATA, coalesce(VERSAO, '') AS VERSAO,
  coalesce(OPERACAO, '') AS OPERACAO, {AS_OF_SQL} AS DATA_ATUALIZACAO, coalesce(FILIAL, '') AS FILIAL,
  coalesce(RATEIO, '') AS RATEIO, coalesce(ORIGEM, '') AS ORIGEM
FROM v WHERE ARQUIVO NOT IN (SELECT ARQUIVO FROM bad)
"""


@register("stream_ingest", _STREAM_SQL)
def q_stream_ingest(spark, sf):
    """Landing folder of CSV files -> availableNow stream -> ledger.

    All raw lines land, faulty or not: the stream's gate rejects the lots. An
    order's lot is whole inside one file, which holds many lots.
    """
    from ..streaming.ingest import run_ingest

    root = scratch_path(spark, "stream")
    n = max(LANDING_FILES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files.write_csv(fx.raw_by_order(spark, sf, n).withColumnRenamed(FILE_COL, LANDED_LOT), f"{root}/landing")
    # two micro-batches however many files land: each one merges into all versions and rewrites them
    store, _ = run_ingest(spark, f"{root}/landing", f"{root}/ledger", f"{root}/audit", f"{root}/checkpoint",
                          as_of=AS_OF, max_files_per_trigger=n // 2, lot_header=LANDED_LOT)
    return store.read()


@register("stream_lots", _STREAM_SQL)
def q_stream_lots(spark, sf):
    """Every lot's lines come in files of two triggers or more, its manifest in a later one; lots are gated whole."""
    from ..streaming.ingest import MANIFEST_MARK, run_lot_ingest

    root = scratch_path(spark, "stream")
    raw = fx.raw_by_order(spark, sf).withColumnRenamed(FILE_COL, LANDED_LOT)
    lots, half = raw.select(LANDED_LOT), F.pmod(F.xxhash64(*RAW_COLUMNS), F.lit(2))
    # as many files from any number of tasks; only a source of fewer parts than files is dealt anew
    deal = raw.coalesce if raw.rdd.getNumPartitions() >= LANDING_FILES // 2 else raw.repartition
    raw = deal(LANDING_FILES // 2)
    files.write_csv(raw.where(half == 0), f"{root}/landing/a")
    files.write_csv(raw.where(half == 1), f"{root}/landing/b")
    counts = lots.groupBy(LANDED_LOT).agg(F.count("*").alias("LINHAS"))
    files.write_csv(counts.repartition(2), f"{root}/landing/c{MANIFEST_MARK}")
    store, _, _ = run_lot_ingest(spark, f"{root}/landing/*", f"{root}/ledger", f"{root}/audit", f"{root}/state", f"{root}/checkpoint",
                                 as_of=AS_OF, lot_header=LANDED_LOT, max_files_per_trigger=LANDING_FILES // 2)
    return store.read()


@register("import_commit", _STREAM_SQL)
def q_import_commit(spark, sf):
    """L1 end to end: rules, whole-lot gate, cost-centre gate, merge into the store, audit."""
    from ..operators.audit import AuditContext
    from ..plans.importer import import_batch
    from ..sources.store import AuditLog

    root = scratch_path(spark, "import")
    store = LedgerStore(spark, f"{root}/ledger")
    import_batch(fx.raw_by_order(spark, sf), store, AuditLog(spark, f"{root}/audit"), AuditContext(as_of=AS_OF))
    return store.read()


def _imported(spark, sf):
    """An import of sixty lots with its outputs, committed; returns the folder of the outputs."""
    from ..operators.audit import AuditContext
    from ..plans.importer import import_batch
    from ..sources.store import AuditLog

    root = scratch_path(spark, "import")
    import_batch(fx.raw(spark, sf, fx.LOT_BY_KIND), LedgerStore(spark, f"{root}/ledger"), AuditLog(spark, f"{root}/audit"),
                 AuditContext(as_of=AS_OF), outputs=f"{root}/saidas")
    return f"{root}/saidas"


# the imported lots with their verdicts: faults first, then the cost-centre gate over lots without faults
_LOTS_SQL = f"""
WITH v AS ({O.validated_sql(f"({fx.sql_raw(fx.LOT_BY_KIND)})")}),
lots AS (SELECT ARQUIVO, count(*) AS TOTAL_LINHAS, count_if(N_ERROS > 0) AS LINHAS_COM_ERRO, CAST(sum(N_ERROS) AS BIGINT) AS TOTAL_ERROS,
  CASE WHEN count_if(N_ERROS > 0) > 0 THEN 'ERROS' WHEN count_if(length(coalesce(N_CENTRO_CUSTO, '')) <> 9) > 0 THEN 'CENTRO_CUSTO' END AS MOTIVO
  FROM v GROUP BY ARQUIVO)
"""
_SHOWN = {"DATA": "CAST(DATA AS VARCHAR)", "VALOR": "CAST(coalesce(VALOR, 0.0) AS DOUBLE)"}
_CELLS = ", ".join(f"{_SHOWN.get(c, f'nullif({c}, {chr(39) * 2})')} AS {c}" for c in LEDGER_COLUMNS if c != "DATA_ATUALIZACAO")


@register("lot_outputs", f"""{_LOTS_SQL}
SELECT k.k AS TIPO, 'processado_' || replace(v.ARQUIVO, '.csv', '') AS SAIDA, {_CELLS}, '' AS ERROS
FROM v JOIN lots USING (ARQUIVO), (VALUES ('csv'), ('xml')) k(k) WHERE MOTIVO IS NULL
UNION ALL
SELECT 'rejeitado', v.ARQUIVO, {_CELLS.replace('coalesce(VALOR, 0.0)', 'VALOR')}, ERROS_TXT FROM v JOIN lots USING (ARQUIVO) WHERE MOTIVO IS NOT NULL
""")
def q_lot_outputs(spark, sf):
    """S6 + S7 + G5: the committed import's CSV, XML and rejected rows of every lot, read back."""
    from ..operators.outputs import read_outputs

    csv, xml, _, rejected = read_outputs(spark, _imported(spark, sf))
    cells = [F.when(F.col(c) != "", F.col(c)).alias(c) if c != "VALOR" else F.col(c).cast("double").alias(c)
             for c in LEDGER_COLUMNS if c != "DATA_ATUALIZACAO"]
    out = [df.select(F.lit(kind).alias("TIPO"), "SAIDA", *cells, errors.alias("ERROS")) for kind, df, errors in (
        ("csv", csv, F.lit("")), ("xml", xml, F.lit("")), ("rejeitado", rejected, F.coalesce("ERROS", F.lit(""))))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("lot_outcomes", f"""{_LOTS_SQL}
SELECT ARQUIVO, TOTAL_LINHAS, LINHAS_COM_ERRO, TOTAL_ERROS, CASE WHEN MOTIVO IS NULL THEN TOTAL_LINHAS ELSE 0 END AS LINHAS_NO_RAZAO,
  CASE WHEN MOTIVO IS NULL THEN 'ACEITO' ELSE 'REJEITADO' END AS RESULTADO, MOTIVO
FROM lots
""")
def q_lot_outcomes(spark, sf):
    """The outcome row of every lot, as the committed import wrote it (times left out)."""
    return spark.read.parquet(f"{_imported(spark, sf)}/resultados").drop("INICIO", "FIM", "DURACAO_S")


@register("gate_profile_lots", f"""{_LOTS_SQL}
SELECT ARQUIVO, c.c AS COLUNA, TOTAL_LINHAS AS TOTAL, CAST(0 AS BIGINT) AS NULOS, true AS OK
FROM lots, (VALUES {', '.join(f"('{c}')" for c in LEDGER_COLUMNS)}) c(c) WHERE LINHAS_COM_ERRO = 0
""")
def q_gate_profile_lots(spark, sf):
    """G7 + G8 per lot: rows and nulls of every ledger column of the lots without faults, as the committed import wrote them."""
    return spark.read.parquet(f"{_imported(spark, sf)}/perfil")


# ---- a chain of commits: the edits, then a delete by filters
_COLS = ", ".join(LEDGER_COLUMNS)
_AFTER_EDIT = f"SELECT {_COLS} FROM ({ORACLE['apply_edits']})"
_AFTER_DELETE = f"SELECT * FROM ({_AFTER_EDIT}) WHERE NOT coalesce(({_sql_filters(F_DELETE)}), false)"


def _changed(spark, sf):
    """A stored ledger, edited and then cut by filters: (store, audit log, state before the edits)."""
    from ..operators.audit import AuditContext
    from ..sources.store import AuditLog
    from .maintenance import delete_records, edit_records

    root = scratch_path(spark, "changes")
    store, audit, ctx = LedgerStore(spark, f"{root}/ledger"), AuditLog(spark, f"{root}/audit"), AuditContext(as_of=AS_OF)
    store.replace_all(fx.led(spark, sf), lote="carga-inicial", as_of=AS_OF)
    first = store.read()
    edit_records(store, audit, fx.edits(spark, sf), ctx)
    delete_records(store, audit, ctx, filters=F_DELETE)
    return store, audit, first


@register("edit_delete_commit", _AFTER_DELETE)
def q_edit_delete_commit(spark, sf):
    """L3: the edit set and the delete by filters, committed one after the other and read back."""
    return _changed(spark, sf)[0].read()


def _images_sql(before: str, after: str, snapshot: int) -> str:
    rest = [c for c in LEDGER_COLUMNS if c not in KEYS]
    return f"""
SELECT CASE WHEN b.VEZES IS NULL THEN 'INSERIDO' WHEN a.VEZES IS NULL THEN 'REMOVIDO' ELSE 'ATUALIZADO' END AS TIPO, {', '.join(KEYS)},
  {', '.join(f'b.{c} AS ANTES_{c}' for c in rest)}, {', '.join(f'a.{c} AS DEPOIS_{c}' for c in rest)},
  coalesce(b.VEZES, a.VEZES) AS VEZES, CAST({snapshot} AS BIGINT) AS SNAPSHOT
FROM (SELECT {_COLS}, count(*) AS VEZES FROM (SELECT {_COLS} FROM {before} EXCEPT ALL SELECT {_COLS} FROM {after}) GROUP BY ALL) b
FULL JOIN (SELECT {_COLS}, count(*) AS VEZES FROM (SELECT {_COLS} FROM {after} EXCEPT ALL SELECT {_COLS} FROM {before}) GROUP BY ALL) a
  USING ({', '.join(KEYS)})"""


@register("row_images", f"{_images_sql(LED, f'({_AFTER_EDIT})', 2)} UNION ALL {_images_sql(f'({_AFTER_EDIT})', f'({_AFTER_DELETE})', 3)}")
def q_row_images(spark, sf):
    """A2 + A3: the change tables that the edit and the delete wrote, every changed row before and after."""
    return _changed(spark, sf)[1].images()


@register("row_images_replay", _AFTER_DELETE)
def q_row_images_replay(spark, sf):
    """A2 + A3: the first state with the two change tables replayed in their order."""
    from ..operators.changes import replay

    _, audit, state = _changed(spark, sf)
    for snapshot in (2, 3):
        state = replay(state, audit.images().where(F.col("SNAPSHOT") == snapshot))
    return state


@register("totals_kept", f"""
SELECT VERSAO, FILIAL, CAST(grouping(VERSAO, FILIAL) AS INTEGER) AS NIVEL, count(*) AS REGISTROS,
  CAST(sum(CAST(VALOR AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS TOTAL_VALOR
FROM ({_AFTER_DELETE}) GROUP BY ROLLUP (VERSAO, FILIAL)""")
def q_totals_kept(spark, sf):
    """R3 kept up to date: the totals of the first state, written, and then only the change tables summed into them."""
    from ..operators import report as RP
    from ..sources.store import stage

    _, audit, first = _changed(spark, sf)
    leaves = stage(RP.category_leaves(first), "totals")
    return RP.totals_of_leaves(RP.updated_leaves(leaves, RP.changed_leaves(audit.images()))).drop("FORA_DO_TOTAL")


_MESSY = {"FILIAL": "filial", "DATA": "Data", "N_CONTA": "N CONTA", "N_CENTRO_CUSTO": " n centro  custo",
          "OPERACAO": "Operação", "VALOR": "valor", "DESCRICAO": "Descrição", "TIPO": "tipo", "VERSAO": "VERSÃO",
          "RATEIO": "Rateio", "ORIGEM": "orígem"}


@register("scan_csv_layouts", f"SELECT {', '.join(RAW_COLUMNS)} FROM {RAW}")
def q_scan_csv_layouts(spark, sf):
    """One folder, two header layouts (order, case, accents, spaces), read back by header."""
    path = scratch_path(spark, "layouts")
    raw = fx.raw(spark, sf)
    opts = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw.where(F.col(FILE_COL) < "lote_5").select(*RAW_COLUMNS).write.options(**opts).csv(path)
    flipped = list(reversed(RAW_COLUMNS))
    (raw.where(F.col(FILE_COL) >= "lote_5").select(*flipped).toDF(*[_MESSY[c] for c in flipped])
     .write.options(**opts).mode("append").csv(path))
    return files.read_csv_files(spark, path).select(*RAW_COLUMNS)
