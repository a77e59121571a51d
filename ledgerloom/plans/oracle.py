"""The same reconciliation in plain SQL for another engine (DuckDB), written apart from the DataFrame code to check it.

CHAIN holds common table expressions over lineitem and orders; each oracle is CHAIN and a SELECT over some of them.
"""

from __future__ import annotations

from ledgerloom.plans import sides

MONEY = "DECIMAL(28,2)"
#: Fixed values, written out here again so that a slip in the code they check shows.
WEAK = (
    "AUTORIZACAO_DUPLICADA", "NSU_DUPLICADO", "PARCELA_VAZIA", "NUMERO_PARCELAS_VAZIO", "BANDEIRA_VAZIA", "MODALIDADE_VAZIA", "STATUS_VAZIO",
    "NSU_FORMATO_INVALIDO", "VALOR_ZERADO", "NSU_VAZIO", "FORMA_PAGAMENTO_AUSENTE", "PARCELAMENTO_NAO_IDENTIFICADO", "DIVERGENCIA_PARCELAMENTO_FORMA_PAGAMENTO", "VALOR_BRUTO_INVALIDO",
)
GROUP_AMBIGUOUS = "AGRUPAMENTO_OS_AMBIGUO"
GROUP_VALUE = "AGRUPAMENTO_OS_VALOR_DIVERGENTE"
GROUP_MATCHED = "CONCILIADO_POR_AGRUPAMENTO_OS_MESMA_AUTORIZACAO"
NOT_AT_ACQUIRER = "NAO_ENCONTRADO_NA_REDE"
NOT_IN_LEDGER = "NAO_ENCONTRADO_NO_SHIFT"
TOLERATED = "DIVERGENCIA_TOLERADA_ATE_2_CENTAVOS"
TOLERATED_ALONE = "CONCILIADO_COM_DIVERGENCIA_TOLERADA"
BY_AUTH = "AUTORIZACAO_COMPATIVEL"
BY_GROUP = "AUTORIZACAO_NORMALIZADA_AGRUPAMENTO_SHIFT"
GROUP_ALONE = "AGRUPAMENTO_OS_SEM_CORRESPONDENCIA_REDE"
LEFT_OVER = "SEM_CORRESPONDENCIA_NO_SHIFT"
REVIEW = "REVISAR_AUTORIZACAO_DIVERGENTE_ALTA_CONFIANCA"
AMBIGUOUS = "AMBIGUO_SEM_AUTORIZACAO_COMPATIVEL"
NOTHING = "SEM_AUTORIZACAO_COMPATIVEL"
NO_ACTION = "Sem ação necessária"
MANUAL = "Revisão manual obrigatória"
OTHER_GROUP = "Outras divergências"
ACTIONS = (
    ("CONCILIADO_COM_DIVERGENCIA_TOLERADA", "Diferença de até R$ 0,02 aceita; manter para auditoria"),
    ("ERRO_CADASTRAL_SHIFT", "Corrigir cadastro no Shift"),
    ("AGRUPAMENTO_OS_AMBIGUO", "Revisão manual obrigatória"),
    ("AGRUPAMENTO_OS_VALOR_DIVERGENTE", "Conferir soma das O.S. agrupadas"),
    ("AGRUPAMENTO_SHIFT_AMBIGUO", "Revisão manual obrigatória"),
    ("DUPLICIDADE_EXATA_SUSPEITA", "Revisar possível linha duplicada no Shift"),
    ("REVISAR_AUTORIZACAO_DIVERGENTE_ALTA_CONFIANCA", "Revisar autorização divergente manualmente."),
    ("AMBIGUO_SEM_AUTORIZACAO_COMPATIVEL", "Revisar manualmente: múltiplos candidatos possíveis, sem correspondência automática."),
    ("DIVERGENCIA_PARCELA", "Verificar parcela"),
    ("DADOS_PARCELA_INSUFICIENTES", "Conferir parcela/quantidade de parcelas manualmente"),
    ("DIVERGENCIA_VALOR_BRUTO", "Verificar valor bruto"),
    ("SEM_AUTORIZACAO_COMPATIVEL", "Verificar se a venda foi processada ou lançada na unidade correta"),
    ("NAO_ENCONTRADO_NA_REDE", "Verificar se a venda foi processada ou lançada na unidade correta"),
    ("NAO_ENCONTRADO_NO_SHIFT", "Cadastrar ou justificar a transação no Shift"),
)
GROUPS = (
    ("AGRUPAMENTO_OS_AMBIGUO", "Agrupamentos ambíguos"),
    ("AGRUPAMENTO_OS_VALOR_DIVERGENTE", "Agrupamentos com valor divergente"),
    ("AGRUPAMENTO_SHIFT_AMBIGUO", "Agrupamentos ambíguos"),
    ("REVISAR_AUTORIZACAO_DIVERGENTE", "Autorizações divergentes para revisão"),
    ("DIVERGENCIA_AUTORIZACAO", "Divergências de autorização"),
    ("DIVERGENCIA_VALOR_BRUTO", "Divergências de valor bruto"),
    ("DIVERGENCIA_VALOR_LIQUIDO", "Divergências de valor líquido"),
    ("DIVERGENCIA_MDR", "Divergências de MDR"),
    ("DIVERGENCIA_PARCELA", "Divergências de parcela"),
    ("DADOS_PARCELA_INSUFICIENTES", "Dados de parcela insuficientes"),
    ("DIVERGENCIA_DATA", "Divergências de data"),
    ("DIVERGENCIA_BANDEIRA", "Divergências de bandeira"),
    ("DIVERGENCIA_MODALIDADE", "Divergências de modalidade"),
    ("NAO_ENCONTRADO_NA_REDE", "Encontradas somente no Shift"),
    ("NAO_ENCONTRADO_NO_SHIFT", "Encontradas somente na Rede"),
    ("POSSIVEL_DUPLICIDADE", "Possíveis duplicidades"),
    ("DUPLICIDADE_EXATA_SUSPEITA", "Duplicidades exatas suspeitas"),
    ("CONCILIADO_COM_DIVERGENCIA_TOLERADA", "Divergências toleradas até R$ 0,02"),
)
COUNTS = {
    "total_conciliado": "^CONCILIADO",
    "total_divergencia_tolerada": "DIVERGENCIA_TOLERADA",
    "total_parcela_compativel_por_restantes": "CONCILIADO_COM_PARCELA_COMPATIVEL_POR_RESTANTES",
    "total_so_rede": "NAO_ENCONTRADO_NO_SHIFT",
    "total_so_shift": "NAO_ENCONTRADO_NA_REDE",
    "total_com_divergencia": "DIVERGENCIA|REVISAO_MANUAL|DADOS_PARCELA_INSUFICIENTES|REVISAR_AUTORIZACAO_DIVERGENTE|AMBIGUO_SEM_AUTORIZACAO_COMPATIVEL|AGRUPAMENTO_SHIFT_AMBIGUO|AGRUPAMENTO_OS_AMBIGUO|AGRUPAMENTO_OS_VALOR_DIVERGENTE|DUPLICIDADE_EXATA_SUSPEITA",
    "total_agrupamento_shift_ambiguo": "AGRUPAMENTO_SHIFT_AMBIGUO|AGRUPAMENTO_OS_AMBIGUO",
    "total_revisar_autorizacao_divergente": "REVISAR_AUTORIZACAO_DIVERGENTE_ALTA_CONFIANCA",
    "total_ambiguo_sem_autorizacao": "AMBIGUO_SEM_AUTORIZACAO_COMPATIVEL",
    "total_erro_cadastral_shift": "ERRO_CADASTRAL_SHIFT",
    "total_duplicidade": "POSSIVEL_DUPLICIDADE|DUPLICIDADE_EXATA_SUSPEITA",
    "total_cancelamento_contestacao": "CANCELAMENTO_CONTESTACAO",
}
RECONCILED = (
    "CONCILIADO", "CONCILIADO_COM_PARCELA_COMPATIVEL_POR_RESTANTES", "CONCILIADO_POR_AGRUPAMENTO_OS_MESMA_AUTORIZACAO", "CONCILIADO_POR_AGRUPAMENTO_SHIFT",
)
BRAND = "CASE WHEN upper({x}) LIKE '%VISA%' THEN 'VISA' WHEN upper({x}) LIKE '%MASTER%' THEN 'MASTERCARD' WHEN upper({x}) LIKE '%ELO%' THEN 'ELO' WHEN upper({x}) LIKE '%AMEX%' THEN 'AMEX' WHEN upper({x}) LIKE '%HIPER%' THEN 'HIPERCARD' ELSE 'OUTRA' END"
MODALITY = "CASE WHEN strip_accents(upper({x})) LIKE '%CREDIT%' THEN 'CREDITO' WHEN strip_accents(upper({x})) LIKE '%DEBIT%' THEN 'DEBITO' WHEN upper({x}) = 'PIX' THEN 'PIX' ELSE 'OUTRA' END"


def _common(part: str) -> str:
    """Normalised columns that both sides have. part: the separator of instalments."""
    return rf"""
        ord, CAST(_line + 2 AS BIGINT) AS linha, autorizacao AS raw_autorizacao,
        CASE WHEN upper(trim(autorizacao)) NOT IN ('', '-') THEN upper(regexp_replace(trim(autorizacao), '\.0+$', '')) END AS ident,
        regexp_replace(ident, '^0+(.)', '\1') AS short,
        CASE WHEN length(short) <= 6 THEN lpad(short, 6, '0') ELSE ident END AS auth, CASE WHEN length(short) > 6 THEN 'AUTORIZACAO_TAMANHO_INVALIDO' END AS err,
        nullif(CASE WHEN regexp_full_match(auth, '[0-9]+') THEN ltrim(auth, '0') ELSE auth END, '') AS auth_key,
        regexp_replace(nsu, '^0+(.)', '\1') AS nsu_norm,
        CAST(replace(valor_bruto_original, ',', '.') AS {MONEY}) AS bruto, CAST(replace(valor_liquido, ',', '.') AS {MONEY}) AS liquido,
        TRY_CAST(split_part(replace(parcela, ' de ', '/'), '/', 1) AS INTEGER) AS atual, TRY_CAST(split_part(replace(parcela, ' de ', '/'), '/', 2) AS INTEGER) AS total,
        CASE WHEN atual > 0 AND total > 0 AND atual <= total THEN total - atual END AS restantes,
        CAST(data_venda AS DATE) AS venda, {BRAND.format(x="bandeira")} AS marca, {MODALITY.format(x="modalidade")} AS modo, upper(status) AS situacao"""


def _how(s: str, r: str) -> str:
    return f"""CASE WHEN {s}.restantes IS NULL OR {r}.restantes IS NULL THEN 'DADOS_PARCELA_INSUFICIENTES' WHEN {s}.atual = {r}.atual AND {s}.total = {r}.total THEN 'EXATA'
        WHEN {s}.restantes = {r}.restantes THEN 'COMPATIVEL_POR_PARCELAS_RESTANTES' ELSE 'DIVERGENCIA_PARCELAS_RESTANTES' END"""


def _texts(*parts: str) -> str:
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def _action(statuses: str) -> str:
    fine = f"len(list_filter({statuses}, lambda x: NOT starts_with(x, 'CONCILIADO') AND x <> '{TOLERATED}')) = 0"
    return f"CASE WHEN {fine} THEN '{NO_ACTION}' " + " ".join(f"WHEN list_contains({statuses}, '{k}') THEN '{v}'" for k, v in ACTIONS) + f" ELSE '{MANUAL}' END"


_A_SQL, _L_SQL = sides.sql("//")
_WEAK = ", ".join(f"'{x}'" for x in WEAK)
_QUALITY = f"""{_texts(f"CASE WHEN len(list_filter(s.codes, lambda x: x NOT IN ({_WEAK}))) > 0 THEN 'ERRO_CADASTRAL_SHIFT' END",
    "CASE WHEN len(list_filter(s.codes, lambda x: contains(x, 'DUPLICAD'))) > 0 THEN 'POSSIVEL_DUPLICIDADE' END",
    "CASE WHEN s.repetida THEN 'DUPLICIDADE_EXATA_SUSPEITA' END")}"""


def _alone(stage: int, statuses: str, fields: str, kind: str, source: str, side: str = "s") -> str:
    """A branch of rows of one side only."""
    other = {"s": "NULL::BIGINT AS r_ord, s.linha AS linha_shift, NULL::BIGINT AS linha_rede, s.bruto AS s_bruto, s.liquido AS s_liquido, NULL::{m} AS r_bruto, NULL::{m} AS r_liquido", "r": "s.ord AS r_ord, NULL::BIGINT, s.linha, NULL::{m}, NULL::{m}, s.bruto, s.liquido"}[side].format(m=MONEY)
    auth = {"s": "s.auth AS s_auth, NULL AS r_auth", "r": "NULL, s.auth"}[side]
    return f"SELECT {stage} AS stage, s.ord AS emit, {other}, {auth}, {statuses} AS statuses, {fields}::VARCHAR[] AS fields, '{kind}' AS kind FROM {source}"


CHAIN = rf"""
WITH RECURSIVE acquirer_rows AS ({_A_SQL}), ledger_rows AS ({_L_SQL}),
a AS (SELECT {_common("/")}, rede_arquivo_origem AS arquivo, CAST(data_recebimento AS DATE) AS recebimento, upper(cancelamento) AS cancelamento FROM acquirer_rows),
l AS (SELECT {_common(" de ")}, empresa, os_shift, codigo_registro FROM ledger_rows),
judged AS (
    SELECT 'REDE' AS origem, ord, linha, arquivo, auth, bruto FROM a UNION ALL SELECT 'SHIFT', ord, linha, NULL, auth, bruto FROM l WHERE empresa = 'FILIAL A'
),
reasons AS (SELECT *, CASE WHEN auth IS NULL THEN 'AUTORIZACAO_AUSENTE' WHEN bruto IS NULL THEN 'VALOR_INVALIDO' WHEN bruto = 0 THEN 'LINHA_ZERADA' END AS motivo FROM judged),
other_company AS (SELECT * FROM l WHERE empresa <> 'FILIAL A'),
va AS (SELECT * FROM a WHERE auth IS NOT NULL AND bruto <> 0),
vl AS (SELECT * FROM l WHERE empresa = 'FILIAL A' AND auth IS NOT NULL AND bruto <> 0),
flagged AS (
    SELECT vl.*, p.n > 1 AND p.signatures > 1 AS ambigua,
           count(*) OVER (PARTITION BY vl.auth, os_shift, codigo_registro, bruto, liquido, venda, atual, total) > 1 AND NOT (p.n > 1 AND p.signatures > 1) AS repetida
    FROM vl JOIN (SELECT auth, count(*) AS n, count(DISTINCT row(empresa, venda, modo, marca, atual, total)) AS signatures FROM vl GROUP BY auth) p ON vl.auth = p.auth
),
groups AS (
    SELECT auth, empresa, venda, modo, marca, atual, total, count(*) AS linhas, sum(bruto)::{MONEY} AS g_bruto, sum(liquido)::{MONEY} AS g_liquido, min(ord) AS primeira,
           string_agg(os_shift, ' | ' ORDER BY ord) AS lista_os, string_agg(CAST(linha AS VARCHAR), ', ' ORDER BY ord) AS lista_linhas
    FROM flagged WHERE NOT ambigua GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT os_shift) > 1
),
placed AS (
    SELECT f.*, g.primeira, g.linhas, g.g_bruto, g.g_liquido, g.lista_os, g.lista_linhas FROM flagged f LEFT JOIN groups g ON NOT f.ambigua AND f.auth = g.auth AND f.empresa = g.empresa AND f.venda = g.venda
         AND f.modo = g.modo AND f.marca = g.marca AND f.atual IS NOT DISTINCT FROM g.atual AND f.total IS NOT DISTINCT FROM g.total
),
cons AS (
    SELECT * EXCLUDE (ord, bruto, liquido, primeira, g_bruto, g_liquido), ord + CASE WHEN linhas IS NULL THEN 0 ELSE 2305843009213693952 END AS ord,
           coalesce(g_bruto, bruto) AS bruto, coalesce(g_liquido, liquido) AS liquido, linhas IS NOT NULL AS agrupada
    FROM placed WHERE primeira IS NULL OR ord = primeira
),
coded AS (
    SELECT *, {_texts(
        "CASE WHEN nsu_norm IS NULL OR nsu_norm = '' THEN 'NSU_VAZIO' END", "CASE WHEN atual IS NULL THEN 'PARCELA_VAZIA' END", "CASE WHEN total IS NULL THEN 'NUMERO_PARCELAS_VAZIO' END",
        "CASE WHEN bruto = 0 THEN 'VALOR_ZERADO' END", "err", "CASE WHEN count(*) OVER (PARTITION BY auth) > 1 THEN 'AUTORIZACAO_DUPLICADA' END",
        "CASE WHEN nsu_norm IS NOT NULL AND count(*) OVER (PARTITION BY nsu_norm) > 1 THEN 'NSU_DUPLICADO' END",
        "CASE WHEN nsu_norm IS NOT NULL AND atual IS NOT NULL AND count(*) OVER (PARTITION BY auth, nsu_norm, bruto, atual) > 1 THEN 'PAGAMENTO_DUPLICADO' END")} AS codes
    FROM cons
),
scored AS (
    SELECT s.auth_key, s.ord AS s_ord, r.ord AS r_ord, coalesce(abs(s.bruto - r.bruto) <= 0.02, false) AS by_value, {_how("s", "r")} AS how,
           list_position(['DIVERGENCIA_PARCELAS_RESTANTES', 'DADOS_PARCELA_INSUFICIENTES', 'COMPATIVEL_POR_PARCELAS_RESTANTES', 'EXATA'], how) - 1 AS rank,
           coalesce(s.nsu_norm = r.nsu_norm AND s.nsu_norm <> '', false) AS by_nsu, coalesce(s.venda = r.venda, false) AS by_date
    FROM coded s JOIN va r ON s.auth_key = r.auth_key AND NOT s.ambigua
),
lists AS (
    SELECT auth_key, s_ord, list({{'v': by_value, 'k': rank, 'n': by_nsu, 'd': by_date, 'o': -r_ord}} ORDER BY by_value DESC, rank DESC, by_nsu DESC, by_date DESC, r_ord) AS candidates,
           row_number() OVER (PARTITION BY auth_key ORDER BY s_ord) AS turn FROM scored GROUP BY auth_key, s_ord
),
turns AS (SELECT t.*, c.agrupada FROM lists t JOIN coded c ON t.s_ord = c.ord),
walk AS (
    SELECT auth_key, 0::BIGINT AS turn, []::BIGINT[] AS used, NULL::BIGINT AS s_ord, NULL::BIGINT AS r_ord, NULL::VARCHAR AS outcome FROM turns WHERE turn = 1
    UNION ALL
    SELECT auth_key, turn, CASE WHEN now = 'taken' THEN list_append(used, pick) ELSE used END, s_ord, pick, now FROM (
        SELECT t.auth_key, t.turn, w.used, t.s_ord, list_filter(t.candidates, lambda c: NOT list_contains(w.used, -c.o)) AS free,
               CASE WHEN len(free) = 0 THEN 'none' WHEN t.agrupada AND len(free) > 1 THEN 'several' ELSE 'taken' END AS now,
               CASE WHEN now = 'taken' THEN -(free[1].o) END AS pick
        FROM walk w JOIN turns t ON w.auth_key = t.auth_key AND t.turn = w.turn + 1
    ) step
),
outcomes AS (SELECT s_ord, r_ord, outcome FROM walk WHERE turn > 0),
pending AS (SELECT s.* FROM coded s LEFT JOIN outcomes o ON s.ord = o.s_ord WHERE NOT s.ambigua AND NOT s.agrupada AND coalesce(o.outcome, 'none') = 'none'),
pool AS (SELECT * FROM va WHERE ord NOT IN (SELECT r_ord FROM outcomes WHERE r_ord IS NOT NULL)),
second AS (
    SELECT s.ord AS s_ord, r.ord AS r_ord, {_how("s", "r")} AS how FROM pending s JOIN pool r ON s.bruto = r.bruto AND s.venda = r.venda AND s.modo = r.modo AND s.marca = r.marca AND abs(r.liquido - s.liquido) <= 0.02
    WHERE how IN ('EXATA', 'COMPATIVEL_POR_PARCELAS_RESTANTES') AND NOT regexp_matches(r.situacao || ' ' || r.cancelamento, 'CANCEL|CONTEST|DESAGEND|ESTORN')
),
counted AS (SELECT *, count(*) OVER (PARTITION BY s_ord) AS n, count(*) OVER (PARTITION BY r_ord) AS m FROM second),
kinds AS (SELECT DISTINCT s_ord, CASE WHEN n = 1 AND m = 1 THEN r_ord END AS r_ord, CASE WHEN n = 1 AND m = 1 THEN '{REVIEW}' ELSE '{AMBIGUOUS}' END AS kind FROM counted),
paired AS (
    SELECT s.*, r.ord AS r_ord, r.linha AS linha_rede, r.bruto AS r_bruto, r.liquido AS r_liquido, r.auth AS r_auth, {_how("s", "r")} AS how, {_QUALITY} AS quality,
           {_texts(f"CASE WHEN {_how('s', 'r')} = 'DIVERGENCIA_PARCELAS_RESTANTES' THEN 'parcela' END", "CASE WHEN s.auth <> r.auth THEN 'autorizacao' END", "CASE WHEN s.nsu_norm <> r.nsu_norm THEN 'nsu' END", "CASE WHEN s.bruto <> r.bruto THEN 'valor_bruto' END",
                   "CASE WHEN s.liquido <> r.liquido THEN 'valor_liquido' END", "CASE WHEN s.modo <> r.modo THEN 'modalidade' END", "CASE WHEN s.marca <> r.marca THEN 'bandeira' END",
                   "CASE WHEN s.situacao <> r.situacao THEN 'status' END", "CASE WHEN s.venda <> r.venda THEN 'data_venda' END")} AS fields,
           coalesce(s.bruto <> r.bruto AND abs(s.bruto - r.bruto) <= 0.02, false) OR coalesce(s.liquido <> r.liquido AND abs(s.liquido - r.liquido) <= 0.02, false) AS tolerada,
           {_texts("CASE WHEN s.auth <> r.auth THEN 'DIVERGENCIA_AUTORIZACAO' END", "CASE WHEN s.nsu_norm <> r.nsu_norm THEN 'DIVERGENCIA_NSU' END", "CASE WHEN abs(s.bruto - r.bruto) > 0.02 THEN 'DIVERGENCIA_VALOR_BRUTO' END",
                   "CASE WHEN abs(s.liquido - r.liquido) > 0.02 THEN 'DIVERGENCIA_VALOR_LIQUIDO' END", "CASE WHEN s.modo <> r.modo THEN 'DIVERGENCIA_MODALIDADE' END", "CASE WHEN s.marca <> r.marca THEN 'DIVERGENCIA_BANDEIRA' END",
                   "CASE WHEN s.situacao <> r.situacao THEN 'DIVERGENCIA_STATUS' END", "CASE WHEN s.venda <> r.venda THEN 'DIVERGENCIA_DATA' END")} AS of_fields,
           regexp_matches(r.cancelamento, 'SIM|CANCEL|CONTEST') AS cancelada
    FROM outcomes o JOIN coded s ON o.s_ord = s.ord JOIN va r ON o.r_ord = r.ord WHERE o.outcome = 'taken'
),
plain AS (
    SELECT *, list_concat(list_concat(quality, {_texts("CASE how WHEN 'DIVERGENCIA_PARCELAS_RESTANTES' THEN 'DIVERGENCIA_PARCELA' WHEN 'DADOS_PARCELA_INSUFICIENTES' THEN 'DADOS_PARCELA_INSUFICIENTES' WHEN 'COMPATIVEL_POR_PARCELAS_RESTANTES' THEN 'CONCILIADO_COM_PARCELA_COMPATIVEL_POR_RESTANTES' END")}),
                          list_concat(of_fields, {_texts("CASE WHEN cancelada THEN 'CANCELAMENTO_CONTESTACAO' END")})) AS found,
           CASE WHEN agrupada AND list_has_any(found, ['DIVERGENCIA_VALOR_BRUTO', 'DIVERGENCIA_VALOR_LIQUIDO'])
                THEN list_append(list_filter(found, lambda x: x NOT IN ('DIVERGENCIA_VALOR_BRUTO', 'DIVERGENCIA_VALOR_LIQUIDO')), '{GROUP_VALUE}') ELSE found END AS judged_list,
           agrupada AND how = 'DIVERGENCIA_PARCELAS_RESTANTES' AS blocked
    FROM paired
),
branches AS (
    SELECT 0 AS stage, ord AS emit, r_ord, linha AS linha_shift, linha_rede, bruto AS s_bruto, liquido AS s_liquido, r_bruto, r_liquido, auth AS s_auth, r_auth,
           CASE WHEN blocked THEN list_append(quality, '{GROUP_AMBIGUOUS}') WHEN len(judged_list) = 0 AND agrupada AND tolerada THEN ['{GROUP_MATCHED}', '{TOLERATED}']
                WHEN len(judged_list) = 0 AND agrupada THEN ['{GROUP_MATCHED}'] WHEN len(judged_list) = 0 AND tolerada THEN ['{TOLERATED_ALONE}']
                WHEN tolerada THEN list_append(judged_list, '{TOLERATED}') WHEN len(judged_list) = 0 THEN ['CONCILIADO'] ELSE judged_list END AS statuses,
           CASE WHEN blocked THEN ['parcela'] ELSE fields END AS fields, CASE WHEN blocked THEN '{GROUP_AMBIGUOUS}' WHEN agrupada THEN '{BY_GROUP}' ELSE '{BY_AUTH}' END AS kind
    FROM plain
    UNION ALL {_alone(0, f"['{GROUP_AMBIGUOUS}']", "['agrupamento_shift']", GROUP_AMBIGUOUS, "coded s WHERE s.ambigua")}
    UNION ALL {_alone(0, f"list_append({_QUALITY}, '{GROUP_AMBIGUOUS}')", "['autorizacao']", GROUP_AMBIGUOUS, "coded s JOIN outcomes o ON s.ord = o.s_ord WHERE o.outcome = 'several'")}
    UNION ALL {_alone(0, f"list_concat({_QUALITY}, ['{NOT_AT_ACQUIRER}', 'MULTIPLAS_OS_MESMA_AUTORIZACAO'])", "[]", GROUP_ALONE, "coded s LEFT JOIN outcomes o ON s.ord = o.s_ord WHERE s.agrupada AND NOT s.ambigua AND coalesce(o.outcome, 'none') = 'none'")}
    UNION ALL SELECT 1, s.ord, r.ord, s.linha, r.linha, s.bruto, s.liquido, r.bruto, r.liquido, s.auth, r.auth, list_append({_QUALITY}, k.kind), ['autorizacao'], k.kind
              FROM kinds k JOIN coded s ON k.s_ord = s.ord JOIN va r ON k.r_ord = r.ord
    UNION ALL {_alone(1, f"list_concat({_QUALITY}, ['{AMBIGUOUS}', '{NOT_AT_ACQUIRER}'])", "['autorizacao']", AMBIGUOUS, "coded s JOIN kinds k ON s.ord = k.s_ord WHERE k.r_ord IS NULL")}
    UNION ALL {_alone(1, f"list_append({_QUALITY}, '{NOT_AT_ACQUIRER}')", "[]", NOTHING, "pending s WHERE s.ord NOT IN (SELECT s_ord FROM kinds)")}
    UNION ALL {_alone(2, f"['{NOT_IN_LEDGER}']", "[]", LEFT_OVER, "pool s WHERE s.ord NOT IN (SELECT r_ord FROM kinds WHERE r_ord IS NOT NULL)", "r")}
),
detail AS (
    SELECT *, array_to_string(statuses, ' + ') AS status, array_to_string(fields, ', ') AS campos, {_action("statuses")} AS acao,
           abs(s_bruto - r_bruto) AS d_bruto, abs(s_liquido - r_liquido) AS d_liquido, coalesce(s_liquido, s_bruto) AS op_s, coalesce(r_liquido, r_bruto) AS op_r,
           CASE WHEN list_contains(statuses, '{NOT_AT_ACQUIRER}') THEN 'l' WHEN list_contains(statuses, '{NOT_IN_LEDGER}') THEN 'a' WHEN list_contains(statuses, '{REVIEW}') THEN 'v'
                WHEN list_contains(statuses, '{GROUP_AMBIGUOUS}') OR list_contains(statuses, '{AMBIGUOUS}') THEN 'x' WHEN list_contains(statuses, 'DIVERGENCIA_VALOR_LIQUIDO') THEN 'n'
                WHEN list_contains(statuses, 'DIVERGENCIA_VALOR_BRUTO') THEN 'g' ELSE 'e' END AS rule,
           CAST(coalesce(CASE rule WHEN 'l' THEN op_s WHEN 'a' THEN op_r WHEN 'v' THEN 0 WHEN 'x' THEN 0 WHEN 'n' THEN d_liquido WHEN 'g' THEN d_bruto ELSE coalesce(nullif(d_liquido, 0), nullif(d_bruto, 0), 0) END, 0) AS {MONEY}) AS confirmado,
           CAST(CASE rule WHEN 'v' THEN coalesce(op_s, op_r, 0) WHEN 'x' THEN coalesce(op_s, 0) + coalesce(op_r, 0) ELSE 0 END AS {MONEY}) AS em_revisao
    FROM branches
)
"""

_GROUP = "CASE " + " ".join(f"WHEN contains(status, '{token}') THEN {k}" for k, (token, _) in enumerate(GROUPS)) + f" ELSE {len(GROUPS)} END"
_LABEL = "CASE " + " ".join(f"WHEN contains(status, '{token}') THEN '{label}'" for token, label in GROUPS) + f" ELSE '{OTHER_GROUP}' END"
_FINE = "status IN (" + ", ".join(f"'{x}'" for x in RECONCILED) + ")"
_COUNTS = " UNION ALL ".join(f"SELECT '{k}' AS indicador, CAST(count(*) FILTER (WHERE regexp_matches(status, '{p}')) AS BIGINT) AS valor FROM detail" for k, p in COUNTS.items())
_REASONS = "SELECT origem, motivo AS motivo_descarte, ord, linha FROM reasons WHERE motivo IS NOT NULL UNION ALL SELECT 'SHIFT', 'EMPRESA_FORA_DO_RECORTE', ord, linha FROM other_company"

SELECTS = {
    "norm_authorization": "SELECT ord, auth AS value, err AS error, auth_key FROM l",
    "norm_nsu": "SELECT ord, nsu_norm AS nsu FROM a",
    "norm_money": "SELECT ord, bruto AS valor_bruto, liquido AS valor_liquido FROM l",
    "norm_instalment": "SELECT ord, atual AS parcela, total AS numero_parcelas, restantes FROM l",
    "norm_date": "SELECT ord, venda AS data_venda FROM l",
    "brand_modality": "SELECT ord, marca AS bandeira, modo AS modalidade FROM a",
    "valid_discard_partition": f"SELECT origem, motivo_descarte, CAST(linha AS VARCHAR) AS numero_linha_original FROM ({_REASONS})",
    "discard_reasons": f"SELECT origem, motivo_descarte, count(*) AS quantidade FROM ({_REASONS}) GROUP BY ALL",
    "unit_filter": "SELECT ord, empresa FROM l WHERE empresa = 'FILIAL A'",
    "context_sets": "SELECT 'data_recebimento' AS campo, CAST(recebimento AS VARCHAR) AS valor FROM va GROUP BY ALL",
    "cross_file_dedup": """, files AS (SELECT *, ord AS o, arquivo AS f FROM a UNION ALL SELECT *, ord + 4611686018427387904, 'c.csv' FROM a WHERE (ord // 100) % 13 = 0),
        counted_files AS (SELECT *, min(o) OVER w AS keeper, max(f) OVER w <> min(f) OVER w AS several FROM files WINDOW w AS (PARTITION BY auth, nsu_norm, bruto, liquido, venda, recebimento, atual, total, marca, modo))
        SELECT o AS ord, f AS rede_arquivo_origem, several AS rede_duplicado_entre_arquivos FROM counted_files WHERE NOT several OR o = keeper""",
    "quality_codes": "SELECT linha AS linha_shift, unnest(codes) AS problema FROM coded",
    "duplicate_flags": "SELECT ord, list_contains(codes, 'AUTORIZACAO_DUPLICADA') AS autorizacao_duplicada, list_contains(codes, 'NSU_DUPLICADO') AS nsu_duplicado, list_contains(codes, 'PAGAMENTO_DUPLICADO') AS pagamento_duplicado FROM coded",
    "split_consolidation": "SELECT ord, linhas AS linhas_agrupadas, bruto AS valor_bruto, liquido AS valor_liquido, lista_os, lista_linhas FROM cons WHERE agrupada",
    "ambiguous_groups": "SELECT ord, ambigua FROM flagged WHERE ambigua",
    "exact_duplicates": "SELECT ord, repetida FROM flagged WHERE repetida",
    "candidate_scores": "SELECT s_ord, r_ord, by_value, CAST(rank AS INTEGER) AS rank, by_nsu, by_date FROM scored",
    "greedy_assignment": "SELECT s_ord, r_ord, outcome FROM outcomes",
    "field_divergences": "SELECT linha_shift, linha_rede, campos FROM detail WHERE campos <> ''",
    "status_detail": "SELECT CAST(stage AS INTEGER) AS stage, emit, linha_shift, linha_rede, kind AS tipo_correspondencia, status AS status_conciliacao FROM detail",
    "recommended_action": "SELECT linha_shift, linha_rede, acao AS acao_recomendada FROM detail",
    "secondary_candidates": "SELECT s_ord, r_ord FROM second",
    "unique_pairs": "SELECT s_ord, r_ord, kind FROM kinds",
    "ledger_only": f"SELECT linha_shift, status AS status_conciliacao FROM detail WHERE list_contains(statuses, '{NOT_AT_ACQUIRER}')",
    "acquirer_only": f"SELECT linha_rede, status AS status_conciliacao FROM detail WHERE list_contains(statuses, '{NOT_IN_LEDGER}')",
    "financial_impact": "SELECT linha_shift, linha_rede, confirmado AS impacto_financeiro_confirmado, em_revisao AS valor_operacao_em_revisao FROM detail",
    "status_totals": "SELECT t AS status, count(*) AS quantidade FROM (SELECT unnest(statuses) AS t FROM detail) GROUP BY t",
    "summary_counts": _COUNTS,
    "money_totals": "SELECT 'valor_bruto_total_rede' AS indicador, CAST(sum(bruto) AS DECIMAL(38,2)) AS valor FROM va UNION ALL SELECT 'valor_liquido_total_rede', CAST(sum(liquido) AS DECIMAL(38,2)) FROM va UNION ALL SELECT 'valor_bruto_total_shift', CAST(sum(bruto) AS DECIMAL(38,2)) FROM cons"
    " UNION ALL SELECT 'valor_liquido_total_shift', CAST(sum(liquido) AS DECIMAL(38,2)) FROM cons UNION ALL SELECT 'diferenca_total_valor_bruto', CAST((SELECT sum(bruto) FROM va) - (SELECT sum(bruto) FROM cons) AS DECIMAL(38,2))"
    " UNION ALL SELECT 'diferenca_total_valor_liquido', CAST((SELECT sum(liquido) FROM va) - (SELECT sum(liquido) FROM cons) AS DECIMAL(38,2))",
    "impact_totals": "SELECT 'impacto_financeiro_confirmado' AS indicador, CAST(sum(confirmado) AS DECIMAL(38,2)) AS valor FROM detail UNION ALL SELECT 'valor_total_em_revisao', CAST(sum(em_revisao) AS DECIMAL(38,2)) FROM detail",
    "value_counts": "SELECT 'bandeira' AS campo, marca AS valor, count(*) AS quantidade FROM cons GROUP BY marca UNION ALL SELECT 'modalidade', modo, count(*) FROM cons GROUP BY modo",
    "divergence_order_top200": f"SELECT row_number() OVER (ORDER BY g, confirmado DESC, em_revisao DESC, chave, stage, emit) AS posicao, label AS grupo_divergencia, linha_shift, linha_rede FROM (SELECT *, {_GROUP} AS g, {_LABEL} AS label, coalesce(s_auth, r_auth, '') AS chave FROM detail WHERE NOT {_FINE}) ORDER BY posicao LIMIT 200",
    "reconciled_authorizations": f"SELECT DISTINCT coalesce(s_auth, r_auth) AS autorizacao FROM detail WHERE {_FINE}",
    "audit_frame": f"SELECT 'GERAL' AS origem, 'motivo_descarte_' || motivo_descarte AS indicador, CAST(count(*) AS DECIMAL(38,2)) AS valor FROM ({_REASONS}) GROUP BY ALL UNION ALL SELECT 'REDE', 'rede_transacoes_enviadas_para_matching', CAST(count(*) AS DECIMAL(38,2)) FROM va UNION ALL SELECT 'SHIFT', 'shift_linhas_validas_para_conciliacao', CAST(count(*) AS DECIMAL(38,2)) FROM vl",
}

OTHERS = {
    "fold_text": "SELECT c_custkey, upper(strip_accents(CASE c_custkey % 4 WHEN 0 THEN 'São José ' WHEN 1 THEN 'crédito à vista ' WHEN 2 THEN 'Ünïted Ñandú ' ELSE 'Ação Ímpar ' END || c_name)) AS folded FROM customer",
    "payment_form_parse": """
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'PIX' ELSE 'REDE' END AS operadora, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'DEBITO' ELSE 'CREDITO' END AS modalidade,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'VISA' WHEN o_orderkey % 3 = 1 THEN 'MASTERCARD' ELSE 'ELO' END AS bandeira,
               CAST(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE o_orderkey % 12 + 1 END AS INTEGER) AS parcelas
        FROM orders""",
    "extract_os": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN '022-' || CAST(o_custkey AS VARCHAR) END AS os_shift FROM orders",
    "card_scope_filter": "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderstatus = 'F'",
    "history_list": "SELECT o_orderkey AS id, n_name AS unidade, CAST(o_orderdate AS DATE) AS data_conciliacao FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'",
    "unit_delete_guard": "SELECT n_nationkey AS unidade_id, count(o_orderkey) AS conciliacoes, count(o_orderkey) = 0 AS pode_excluir FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey",
}

ORACLE_SQL = {name: f"{CHAIN} {select}" for name, select in SELECTS.items()} | OTHERS
