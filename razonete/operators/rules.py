"""The rule catalogue (V1-V12) as data.

Every rule is a ``(field, rule id, message, predicate, profiles)`` record. The
predicate receives a :class:`Row` of column expressions and returns a boolean
Column that is TRUE when the row violates the rule. Two profiles exist:

* ``as_coded``   - the rules the reference's row loop actually enforces;
* ``documented`` - every written rule, including validators that exist but are
  never called, and the extras of the rules document.

Null checks come first in every rule: nulls are never turned into text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, numbers, text

AS_CODED = "as_coded"
DOCUMENTED = "documented"
PROFILES = (AS_CODED, DOCUMENTED)
BOTH = frozenset(PROFILES)
DOC_ONLY = frozenset({DOCUMENTED})

# --- fixed values: error messages, exactly as the reference reports them ----
MSG_FILIAL_EMPTY = "Filial não pode ser vazia"
MSG_FILIAL_DIGITS = "Filial deve ter 4 dígitos"
MSG_CONTA_NULL = "Número da conta não pode ser nulo"
MSG_CONTA_DIGITS = "Número da conta deve ter 8 dígitos"
MSG_CC_NULL = "Centro de custo não pode ser nulo quando N_CONTA não começa com 1"
MSG_CC_DIGITS = "Centro de custo deve ter 9 dígitos"
MSG_OPERACAO_LEN = "Operação não pode ter mais de 10 caracteres"
MSG_RATEIO = "Rateio deve ser 'SIM' ou 'NÃO'"
MSG_ORIGEM_LEN = "Origem não pode ter mais de 60 caracteres"
MSG_VALOR = "Valor inválido"
MSG_DESCRICAO_EMPTY = "Descrição não pode ser vazia"
MSG_VERSAO_NULL = "Versão não pode ser nula"
MSG_VERSAO_PATTERN = "Versão deve seguir o padrão 'YYYY - VX'"
MSG_DATA_EMPTY = "Data não pode ser vazia"
MSG_DATA_INVALID = "Data inválida. Use o formato DD/MM/AAAA"
RATEIO_ALLOWED = ["SIM", "NAO", "NÃO"]
VERSAO_PATTERN = r"^[0-9]{4} - V[0-9]+$"
MAX_OPERACAO = 10
MAX_ORIGEM = 60
# documented-only extras (messages of our own; the document states the rule)
MSG_FILIAL_PREFIX = "Filial deve começar com 0"
MSG_VALOR_NULL = "Valor não pode ser nulo"
MSG_VALOR_POSITIVE = "Valor deve ser maior que zero"
MSG_VALOR_DECIMALS = "Valor deve ter no máximo 2 casas decimais"
MSG_DESCRICAO_LEN = "Descrição não pode ter mais de 100 caracteres"
MAX_DESCRICAO = 100
# -----------------------------------------------------------------------------


PREP = "__n_"  # prefix of the columns holding normalised values during validation


class Row:
    """Column expressions a predicate may use; built once per batch schema.

    ``norm(field)`` is the field's normalised value. In *prepared* mode it is
    a reference to a column computed once by a first projection, so a regex
    used by several rules and by the output runs once per row.
    """

    def __init__(self, columns, profile: str, date_formats, prepared: bool = False):
        self.present = set(columns)
        self.profile = profile
        self.date_formats = tuple(date_formats) or (dates.DAY_FIRST,)
        self.prepared = prepared

    def raw(self, name: str) -> Column:
        return F.col(name) if name in self.present else F.lit(None).cast("string")

    def has(self, name: str) -> bool:
        return name in self.present

    def blank(self, name: str) -> Column:
        return text.is_blank(self.raw(name))

    def compute(self, name: str) -> Column:
        """The normalised value of ``name`` as an expression over the raw column."""
        c = self.raw(name)
        if name == "FILIAL":
            return text.zfill_branch(c)
        if name == "DATA":
            return dates.parse_date(c, self.date_formats)
        if name == "VALOR":
            return numbers.parse_valor_br(c) if self.profile == DOCUMENTED else numbers.parse_valor(c)
        if name in ("OPERACAO", "DESCRICAO", "TIPO", "RATEIO"):
            return text.squash_upper(c)
        if name in ("ORIGEM", "VERSAO"):
            return text.clean_text(c)
        if name in ("N_CONTA", "N_CENTRO_CUSTO"):
            return text.digits_only(c)
        raise KeyError(name)

    def norm(self, name: str) -> Column:
        return F.col(PREP + name) if self.prepared else self.compute(name)

    # shorthands used by the output projection
    def filial(self) -> Column:
        return self.norm("FILIAL")

    def data(self) -> Column:
        return self.norm("DATA")

    def valor(self) -> Column:
        return self.norm("VALOR")


NORMALISED_FIELDS = ["FILIAL", "DATA", "VALOR", "OPERACAO", "DESCRICAO", "TIPO", "RATEIO", "ORIGEM",
                     "VERSAO", "N_CONTA", "N_CENTRO_CUSTO"]


@dataclass(frozen=True)
class Rule:
    field: str
    rule_id: str
    message: str
    predicate: Callable[[Row], Column]
    profiles: frozenset = field(default=BOTH)
    wired: bool = True              # called by the reference's row loop
    optional_column: bool = False   # rule applies only when the column exists

    def applies(self, row: Row) -> bool:
        return row.profile in self.profiles and (not self.optional_column or row.has(self.field))

    def fails(self, row: Row) -> Column:
        return F.coalesce(self.predicate(row), F.lit(False))


def _filial_digits(r: Row) -> Column:
    return ~r.blank("FILIAL") & ~r.filial().rlike(r"^[0-9]{4}$")


def _filial_prefix(r: Row) -> Column:
    f = r.filial()
    return ~r.blank("FILIAL") & f.rlike(r"^[0-9]{4}$") & ~f.startswith("0")


def _data_invalid(r: Row) -> Column:
    return ~r.blank("DATA") & r.data().isNull()


def _valor_invalid(r: Row) -> Column:
    return r.raw("VALOR").isNotNull() & r.valor().isNull()


def _operacao_len(r: Row) -> Column:
    return ~r.blank("OPERACAO") & (F.length(r.norm("OPERACAO")) > MAX_OPERACAO)


def _rateio(r: Row) -> Column:
    return ~r.blank("RATEIO") & ~r.norm("RATEIO").isin(RATEIO_ALLOWED)


def _origem_len(r: Row) -> Column:
    return ~r.blank("ORIGEM") & (F.length(r.norm("ORIGEM")) > MAX_ORIGEM)


def _conta_digits(r: Row) -> Column:
    return r.raw("N_CONTA").isNotNull() & (F.length(r.norm("N_CONTA")) != 8)


def _cc_null(r: Row) -> Column:
    conta_starts_1 = F.coalesce(r.raw("N_CONTA").startswith("1"), F.lit(False))
    return r.raw("N_CENTRO_CUSTO").isNull() & ~conta_starts_1


def _cc_digits(r: Row) -> Column:
    return r.raw("N_CENTRO_CUSTO").isNotNull() & (F.length(r.norm("N_CENTRO_CUSTO")) != 9)


def _versao_pattern(r: Row) -> Column:
    return r.raw("VERSAO").isNotNull() & ~r.norm("VERSAO").rlike(VERSAO_PATTERN)


def _valor_positive(r: Row) -> Column:
    v = r.valor()
    return (v <= F.lit(0.0)) | F.isnan(v) | (v == F.lit(float("inf")))  # not a positive finite amount


def _valor_decimals(r: Row) -> Column:
    return ~numbers.has_at_most_2_decimals(r.valor())


def _descricao_len(r: Row) -> Column:
    return ~r.blank("DESCRICAO") & (F.length(r.norm("DESCRICAO")) > MAX_DESCRICAO)


# Order = reference row-loop order (FILIAL, TIPO, DATA, VALOR, DESCRICAO,
# OPERACAO, RATEIO, ORIGEM), then the validators it never calls, then extras.
# TIPO (V9) never fails, so it contributes no rule.
CATALOGUE: list[Rule] = [
    Rule("FILIAL", "V1.vazia", MSG_FILIAL_EMPTY, lambda r: r.blank("FILIAL")),
    Rule("FILIAL", "V1.digitos", MSG_FILIAL_DIGITS, _filial_digits),
    Rule("DATA", "V11.vazia", MSG_DATA_EMPTY, lambda r: r.blank("DATA")),
    Rule("DATA", "V11.invalida", MSG_DATA_INVALID, _data_invalid),
    Rule("VALOR", "V7.invalido", MSG_VALOR, _valor_invalid),
    Rule("DESCRICAO", "V8.vazia", MSG_DESCRICAO_EMPTY, lambda r: r.blank("DESCRICAO")),
    Rule("OPERACAO", "V4.tamanho", MSG_OPERACAO_LEN, _operacao_len, optional_column=True),
    Rule("RATEIO", "V5.dominio", MSG_RATEIO, _rateio, optional_column=True),
    Rule("ORIGEM", "V6.tamanho", MSG_ORIGEM_LEN, _origem_len, optional_column=True),
    Rule("N_CONTA", "V2.nula", MSG_CONTA_NULL, lambda r: r.raw("N_CONTA").isNull(), DOC_ONLY, wired=False),
    Rule("N_CONTA", "V2.digitos", MSG_CONTA_DIGITS, _conta_digits, DOC_ONLY, wired=False),
    Rule("N_CENTRO_CUSTO", "V3.nulo", MSG_CC_NULL, _cc_null, DOC_ONLY, wired=False),
    Rule("N_CENTRO_CUSTO", "V3.digitos", MSG_CC_DIGITS, _cc_digits, DOC_ONLY, wired=False),
    Rule("VERSAO", "V10.nula", MSG_VERSAO_NULL, lambda r: r.raw("VERSAO").isNull(), DOC_ONLY, wired=False),
    Rule("VERSAO", "V10.padrao", MSG_VERSAO_PATTERN, _versao_pattern, DOC_ONLY, wired=False),
    Rule("FILIAL", "V12.prefixo", MSG_FILIAL_PREFIX, _filial_prefix, DOC_ONLY),
    Rule("VALOR", "V12.nulo", MSG_VALOR_NULL, lambda r: r.raw("VALOR").isNull(), DOC_ONLY),
    Rule("VALOR", "V12.positivo", MSG_VALOR_POSITIVE, _valor_positive, DOC_ONLY),
    Rule("VALOR", "V12.decimais", MSG_VALOR_DECIMALS, _valor_decimals, DOC_ONLY),
    Rule("DESCRICAO", "V12.tamanho", MSG_DESCRICAO_LEN, _descricao_len, DOC_ONLY),
]


def rules_for(columns, profile: str = AS_CODED, fields=None) -> list[Rule]:
    """Rules that apply to a batch with these columns under ``profile``."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; expected one of {PROFILES}")
    row = Row(columns, profile, (dates.DAY_FIRST,))
    return [r for r in CATALOGUE if r.applies(row) and (fields is None or r.field in fields)]
