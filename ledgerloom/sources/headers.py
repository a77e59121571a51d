"""Headers of uploaded tables to canonical fields: exact after folding, else by similarity. Column names only, no rows."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

#: The canonical fields, and the headers by which files name them.
CANONICAL = {
    "data_recebimento": ("data do recebimento", "data recebimento"),
    "data_venda": ("data original da venda", "data da venda", "data venda"),
    "data_vencimento": ("data original de vencimento", "data vencimento"),
    "valor_bruto_original": ("valor bruto da parcela original", "valor bruto", "valor"),
    "valor_bruto_atualizado": ("valor bruto da parcela atualizada", "valor atualizado"),
    "taxa_mdr": ("taxa mdr", "mdr percentual"),
    "valor_mdr": ("valor mdr descontado", "valor mdr", "mdr descontado"),
    "valor_liquido": ("valor liquido da parcela", "valor líquido", "valor liquido"),
    "nsu": ("nsu/cv", "nsu_cv", "nsu", "cv"),
    "autorizacao": ("numero da autorizacao", "número da autorização", "autorizacao", "autorização"),
    "lote": ("resumo de vendas/numero do lote", "numero do lote", "lote"),
    "nome_estabelecimento": ("nome do estabelecimento", "nome estabelecimento"),
    "estabelecimento": ("estabelecimento", "codigo estabelecimento"),
    "numero_cartao": ("numero do cartao", "cartao"),
    "modalidade": ("modalidade", "tipo pagamento"),
    "bandeira": ("bandeira",),
    "numero_parcelas": ("numero de parcelas", "quantidade parcelas", "qtd parcelas"),
    "parcela": ("parcela", "parcela atual"),
    "banco": ("banco",),
    "agencia": ("agencia",),
    "conta": ("conta-corrente", "conta corrente", "conta"),
    "cancelamento": ("cancelamento/contestacao", "cancelamento", "contestacao"),
    "data_cancelamento": ("data do cancelamento", "data cancelamento"),
    "status": ("status", "situacao"),
}
LEAST_SIMILARITY = 0.88
#: Terms by which a row is told to be a header.
TERMS = ("autorizacao", "nsu", "valor bruto", "parcela", "bandeira", "modalidade", "estabelecimento", "data", "status")


def folded(text: object) -> str:
    plain = unicodedata.normalize("NFKD", "" if text is None else str(text))
    return " ".join("".join(c for c in plain if not unicodedata.combining(c)).lower().split())


def mapping(columns: list[str]) -> dict[str, str]:
    """Canonical field to column. One column may serve several fields; the best similarity wins, then the larger name."""
    own = {c: folded(c) for c in columns}
    out = {}
    for field, names in CANONICAL.items():
        aliases = [folded(x) for x in names]
        if exact := [c for c, text in own.items() if text in aliases]:
            out[field] = exact[0]
            continue
        score, best = max(((SequenceMatcher(None, text, a).ratio(), c) for c, text in own.items() for a in aliases), default=(0.0, ""))
        if score >= LEAST_SIMILARITY:
            out[field] = best
    return out


def header_score(cells: list[str | None]) -> int:
    text = " | ".join(folded(c) for c in cells if c is not None)
    return sum(term in text for term in TERMS)
