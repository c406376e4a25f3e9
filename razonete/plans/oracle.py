"""DuckDB SQL mirrors of the normalisers and rules, for the oracle check.

Each helper returns SQL text computing the same value as the Spark Column of
the same name. Notes on parity: DuckDB's ``\\s`` is ASCII-only and its
``upper('ß')`` is ``ẞ`` (Spark gives ``SS``), so ``ß`` is replaced first.
"""

from __future__ import annotations

from ..functions.text import ACCENTED, PLAIN
from ..operators import rules as R
from ..schema import RAW_COLUMNS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {x} = '')"


def squash(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def upper(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'ss'))"


def squash_upper(x: str) -> str:
    return upper(squash(x))


def clean(x: str) -> str:
    return squash(f"translate({upper(x)}, {q(ACCENTED)}, {q(PLAIN)})")


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def zfill(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN regexp_matches({s}, '^[0-9]+$') AND length({s}) < 4 THEN lpad({s}, 4, '0') ELSE {s} END)"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def parse_date(x: str, fmts=("%d/%m/%Y",)) -> str:
    parts = [f"CAST(try_strptime(trim({x}), {q(f)}) AS DATE)" for f in fmts]
    return parts[0] if len(parts) == 1 else f"coalesce({', '.join(parts)})"


FLEX_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y")


def parse_valor(x: str) -> str:
    return f"TRY_CAST(trim({x}) AS DOUBLE)"


def parse_valor_br(x: str) -> str:
    s = f"trim({x})"
    return (f"TRY_CAST(CASE WHEN regexp_matches({s}, ',.*\\.') THEN NULL WHEN contains({s}, ',') THEN replace(replace({s}, '.', ''), ',', '.') "
            f"ELSE {s} END AS DOUBLE)")


def default_tipo(x: str) -> str:
    return f"(CASE WHEN {blank(x)} THEN 'ORCADO' ELSE {squash_upper(x)} END)"


def normalize_rateio(x: str) -> str:
    su = squash_upper(x)
    return f"(CASE WHEN {blank(x)} THEN '' WHEN {su} = 'NÃO' THEN 'NAO' ELSE {su} END)"


def empty_or(x: str, expr: str) -> str:
    return f"(CASE WHEN {blank(x)} THEN '' ELSE {expr} END)"


def valor_for(profile: str) -> str:
    return parse_valor_br("VALOR") if profile == R.DOCUMENTED else parse_valor("VALOR")


# rule id -> SQL predicate (TRUE = violated), mirroring razonete.operators.rules
def rule_sql(rule_id: str, profile: str = R.AS_CODED) -> str:
    fz = zfill("FILIAL")
    v = valor_for(profile)
    preds = {
        "V1.vazia": blank("FILIAL"),
        "V1.digitos": f"NOT {blank('FILIAL')} AND NOT regexp_matches({fz}, '^[0-9]{{4}}$')",
        "V11.vazia": blank("DATA"),
        "V11.invalida": f"NOT {blank('DATA')} AND {parse_date('DATA')} IS NULL",
        "V7.invalido": f"VALOR IS NOT NULL AND {v} IS NULL",
        "V8.vazia": blank("DESCRICAO"),
        "V4.tamanho": f"NOT {blank('OPERACAO')} AND length({squash_upper('OPERACAO')}) > {R.MAX_OPERACAO}",
        "V5.dominio": f"NOT {blank('RATEIO')} AND {squash_upper('RATEIO')} NOT IN ('SIM', 'NAO', 'NÃO')",
        "V6.tamanho": f"NOT {blank('ORIGEM')} AND length({clean('ORIGEM')}) > {R.MAX_ORIGEM}",
        "V2.nula": "N_CONTA IS NULL",
        "V2.digitos": f"N_CONTA IS NOT NULL AND length({digits('N_CONTA')}) <> 8",
        "V3.nulo": "N_CENTRO_CUSTO IS NULL AND NOT coalesce(starts_with(N_CONTA, '1'), false)",
        "V3.digitos": f"N_CENTRO_CUSTO IS NOT NULL AND length({digits('N_CENTRO_CUSTO')}) <> 9",
        "V10.nula": "VERSAO IS NULL",
        "V10.padrao": f"VERSAO IS NOT NULL AND NOT regexp_matches({clean('VERSAO')}, {q(R.VERSAO_PATTERN)})",
        "V12.prefixo": (f"NOT {blank('FILIAL')} AND regexp_matches({fz}, '^[0-9]{{4}}$') "
                        f"AND NOT starts_with({fz}, '0')"),
        "V12.nulo": "VALOR IS NULL",
        "V12.positivo": f"{v} <= 0.0",
        "V12.decimais": f"NOT ({v} = round({v}, 2))",
        "V12.tamanho": f"NOT {blank('DESCRICAO')} AND length({squash_upper('DESCRICAO')}) > {R.MAX_DESCRICAO}",
    }
    return f"coalesce(({preds[rule_id]}), false)"


def active_rules(profile: str, fields=None, columns=None):
    row = R.Row(columns or RAW_COLUMNS, profile, ())
    return [r for r in R.CATALOGUE if r.applies(row) and (fields is None or r.field in fields)]


def errors_sql(profile: str = R.AS_CODED, fields=None, rules=None) -> tuple[str, str]:
    """(N_ERROS expression, ERROS_TXT expression) over the active rules."""
    rs = rules if rules is not None else active_rules(profile, fields)
    if not rs:
        return "CAST(0 AS BIGINT)", "''"
    n = " + ".join(f"CAST({rule_sql(r.rule_id, profile)} AS BIGINT)" for r in rs)
    txt = "concat_ws('; ', " + ", ".join(
        f"CASE WHEN {rule_sql(r.rule_id, profile)} THEN {q(r.message)} END" for r in rs
    ) + ")"
    return f"({n})", txt


def normalised_sql(profile: str = R.AS_CODED) -> dict[str, str]:
    """Column -> SQL of the normalised value produced by ``apply_rules``."""
    fz = zfill("FILIAL")
    return {
        "FILIAL": f"(CASE WHEN NOT {blank('FILIAL')} AND regexp_matches({fz}, '^[0-9]{{4}}$') THEN {fz} ELSE FILIAL END)",
        "DATA": parse_date("DATA"),
        "N_CONTA": "N_CONTA",
        "N_CENTRO_CUSTO": "N_CENTRO_CUSTO",
        "OPERACAO": empty_or("OPERACAO", squash_upper("OPERACAO")),
        "VALOR": valor_for(profile),
        "DESCRICAO": squash_upper("DESCRICAO"),
        "TIPO": default_tipo("TIPO"),
        "VERSAO": clean("VERSAO") if profile == R.DOCUMENTED else "VERSAO",
        "RATEIO": normalize_rateio("RATEIO"),
        "ORIGEM": empty_or("ORIGEM", clean("ORIGEM")),
    }


def validated_sql(source: str, profile: str = R.AS_CODED, extra: str = "") -> str:
    """SELECT over ``source`` (raw layout + ARQUIVO) with normalised columns and faults."""
    norm = normalised_sql(profile)
    n, txt = errors_sql(profile)
    cols = ",\n  ".join(f"{expr} AS {c}" for c, expr in norm.items())
    extra_cols = f"{extra},\n  " if extra else ""
    return f"SELECT ARQUIVO,\n  {extra_cols}{cols},\n  {n} AS N_ERROS,\n  {txt} AS ERROS_TXT\nFROM {source}"
