"""DuckDB statements that answer every registered query independently of Spark.

They follow the query semantics in the plainest form: join first, aggregate afterwards, no
reduction before a join. The star schema is inlined as common table expressions.
"""

from __future__ import annotations

from quadrante.model import (
    HIGHLIGHT_COLOURS,
    INSPECTION_EXTRA,
    INSPECTION_MEASURES,
    NO_DATA_TEXT,
    PALETTE,
    SERVICE_TYPES,
    TYPE_NAMES,
    VEHICLES,
    VIEWS,
    ServiceType,
)
from quadrante.operators.classes import FIXED_BREAKS
from quadrante.plans.overview import HEADER_LABELS
from quadrante.verification.registry import (
    PART_OFFSET,
    PRIORITIES,
    REGION_OFFSET,
    SEGMENTS,
    UNMAPPED_OFFSET,
    YEAR,
)


def _percent(name: str) -> str:
    return f"NULLIF(CAST(ROUND({name} * 100) AS BIGINT), 0)"


def _count_if(condition: str) -> str:
    return f"CAST(SUM(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


def _schema_ctes() -> str:
    qty, line = "CAST(l_quantity AS BIGINT)", "CAST(l_linenumber AS BIGINT)"
    inspections = [
        qty,
        line,
        _percent("l_tax"),
        f"CASE WHEN l_returnflag = 'A' THEN {qty} ELSE 0 END",
        f"CASE WHEN l_returnflag = 'N' THEN {qty} ELSE 0 END",
        f"CASE WHEN l_returnflag = 'R' THEN {qty} ELSE 0 END",
        f"CASE WHEN l_linestatus = 'O' THEN {line} ELSE 0 END",
        f"CASE WHEN l_linestatus = 'F' THEN {line} ELSE 0 END",
        "CAST(month(l_shipdate) AS BIGINT)",
        "CAST(day(l_shipdate) AS BIGINT)",
        "CAST(floor(l_extendedprice / 10000) AS BIGINT)",
    ]
    measures = ", ".join(f"{e} AS {n}" for e, n in zip(inspections, INSPECTION_MEASURES))
    vehicles = list(VEHICLES)
    counts = [f"NULLIF({_count_if(f"o_orderpriority = '{PRIORITIES[0]}'")}, 0) AS {vehicles[0]}"]
    counts += [f"{_count_if(f"o_orderpriority = '{p}'")} AS {v}" for p, v in zip(PRIORITIES[1:], vehicles[1:5])]
    counts += [f"{_count_if(f"c_mktsegment = '{s}'")} AS {v}" for s, v in zip(SEGMENTS, vehicles[5:])]
    l_year, o_year = "CAST(year(l_shipdate) AS INT)", "CAST(year(o_orderdate) AS INT)"
    ctes = {
        "municipios": "SELECT CAST(n_nationkey AS INT) AS id_municipio, n_name AS nome FROM nation"
        f" UNION ALL SELECT CAST(r_regionkey + {REGION_OFFSET} AS INT), r_name FROM region"
        f" UNION ALL SELECT CAST(p_partkey + {PART_OFFSET} AS INT), p_name FROM part",
        "credenciados": "SELECT CAST(s_suppkey AS VARCHAR) AS cnpj, s_name AS razao_social,"
        " CAST(s_nationkey AS INT) AS id_municipio FROM supplier"
        " UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS INT) FROM customer"
        " UNION ALL SELECT CAST(user_id AS VARCHAR), 'User#' || user_id,"
        f" CAST(event_id + {PART_OFFSET} AS INT) FROM events",
        "servicos_cfc": f"SELECT CAST(l_suppkey AS VARCHAR) AS cnpj, {l_year} AS ano,"
        f" CASE WHEN l_linestatus = 'O' THEN {qty} END AS cursos_teoricos,"
        f" CASE WHEN l_linestatus = 'F' THEN {qty} END AS cursos_praticos FROM lineitem",
        "servicos_clinicas": f"SELECT CAST(o_custkey AS VARCHAR) AS cnpj, {o_year} AS ano,"
        " CAST(floor(o_totalprice / 1000) AS BIGINT) AS exames_medicos,"
        " CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 5000) AS BIGINT) END"
        " AS exames_psicologicos FROM orders",
        "servicos_ecv": f"SELECT CAST(l_partkey AS VARCHAR) AS cnpj, {l_year} AS ano, {measures},"
        f" {_percent('l_discount')} AS {INSPECTION_EXTRA} FROM lineitem",
        "servicos_epiv": f"SELECT CAST(l_orderkey AS VARCHAR) AS cnpj, {l_year} AS ano,"
        f" {line} AS estampagens FROM lineitem",
        "servicos_patio": f"SELECT CAST(o_orderkey AS VARCHAR) AS cnpj, {o_year} AS ano,"
        " CASE o_orderstatus WHEN 'F' THEN CAST(floor(o_totalprice / 10000) AS BIGINT)"
        " WHEN 'O' THEN 1 END AS veiculos_removidos FROM orders",
        "populacao": "SELECT CAST(c_nationkey AS INT) AS id_municipio, COUNT(*) * 1000 AS populacao"
        " FROM customer GROUP BY c_nationkey",
        "frotas": "SELECT CAST(c_nationkey AS INT) AS id_municipio,"
        f" CASE WHEN o_orderstatus <> 'P' THEN {o_year} END AS ano, {', '.join(counts)}"
        " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, 2, o_orderstatus",
        "geo": "SELECT CAST(id_municipio AS VARCHAR) AS id, nome AS name FROM municipios"
        f" UNION ALL SELECT CAST(r_regionkey + {UNMAPPED_OFFSET} AS VARCHAR), r_name FROM region",
    }
    return ", ".join(f"{name} AS ({sql})" for name, sql in ctes.items())


def _sql(body: str, **ctes: str) -> str:
    more = "".join(f", {name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH {_schema_ctes()}{more} {body}"


def _quantity(st: ServiceType, index: int, extended: bool = False, alias: str = "s") -> str:
    component = st.components[index]
    names = component.measures + ((INSPECTION_EXTRA,) if extended else ())
    return f"CAST(COALESCE(SUM({' + '.join(f'{alias}.{n}' for n in names)}), 0) AS BIGINT)"


def _entity_totals() -> str:
    return (
        "SELECT m.id_municipio, m.nome AS nome_municipio, COUNT(DISTINCT c.cnpj) AS total_credenciados,"
        " CAST(COALESCE(p.populacao, 0) AS BIGINT) AS populacao FROM municipios m"
        " LEFT JOIN credenciados c USING (id_municipio) LEFT JOIN populacao p USING (id_municipio)"
        " GROUP BY m.id_municipio, m.nome, p.populacao"
    )


def _with_facts(st: ServiceType, columns: list[str]) -> str:
    return (
        f"SELECT m.id_municipio, m.nome AS nome_municipio, {', '.join(columns)} FROM municipios m"
        f" LEFT JOIN credenciados c USING (id_municipio)"
        f" LEFT JOIN {st.table} s ON s.cnpj = c.cnpj AND s.ano = {YEAR} GROUP BY ALL"
    )


def _entities_with_service(st: ServiceType) -> str:
    return _with_facts(st, [f"COUNT(DISTINCT s.cnpj) AS {st.count_column}"])


def _service_totals(st: ServiceType, extended: bool = False) -> str:
    quantities = [_quantity(st, i, extended) for i in range(len(st.components))]
    columns = [f"{q} AS {c.column}" for q, c in zip(quantities, st.components)]
    if len(columns) > 1:
        columns.append(f"{' + '.join(quantities)} AS {st.total_column}")
    return _with_facts(st, columns)


def _latest_fleet() -> str:
    counts = [f"CAST(COALESCE(f.{v}, 0) AS BIGINT)" for v in VEHICLES]
    return (
        "SELECT m.id_municipio, m.nome AS nome_municipio, CAST(COALESCE(p.populacao, 0) AS BIGINT) AS populacao,"
        f" f.ano AS ano_frota, {', '.join(f'{c} AS {v}' for c, v in zip(counts, VEHICLES))},"
        f" {' + '.join(counts)} AS total_frota FROM municipios m"
        " LEFT JOIN populacao p USING (id_municipio) LEFT JOIN (SELECT * FROM frotas"
        " QUALIFY ano = MAX(ano) OVER (PARTITION BY id_municipio)) f USING (id_municipio)"
    )


def _one_fleet() -> str:
    order = ", ".join(f"{v} DESC" for v in ("total_frota", *VEHICLES, "populacao"))
    return f"SELECT * FROM frota QUALIFY row_number() OVER (PARTITION BY id_municipio ORDER BY {order}) = 1"


def _one_total() -> str:
    return (
        "SELECT * FROM totais QUALIFY row_number() OVER"
        " (PARTITION BY id_municipio ORDER BY populacao DESC, total_credenciados DESC) = 1"
    )


def _fleet_lines(source: str, columns: str) -> str:
    parts = [
        f"SELECT {columns}, {i} AS ordem, '{label}' AS tipo, {column} AS quantidade FROM {source}"
        for i, (column, label) in enumerate(VEHICLES.items(), start=1)
    ]
    return " UNION ALL ".join(parts)


def _service_entities(st: ServiceType) -> str:
    return (
        f"SELECT c.id_municipio, c.cnpj, c.razao_social FROM credenciados c JOIN {st.table} s ON s.cnpj = c.cnpj"
        f" WHERE s.ano = {YEAR} GROUP BY ALL"
    )


def _service_lines(names: tuple[str, ...] = TYPE_NAMES) -> str:
    """Rows (id_municipio, tipo_servico, ordem, tipo, quantidade) of the given types."""
    parts, order = [], 0
    for name in names:
        st = SERVICE_TYPES[name]
        for i, component in enumerate(st.components):
            order += 1
            parts.append(
                f"SELECT m.id_municipio, '{name}' AS tipo_servico, {order} AS ordem, '{component.label}' AS tipo,"
                f" {_quantity(st, i)} AS quantidade FROM municipios m LEFT JOIN credenciados c USING (id_municipio)"
                f" LEFT JOIN {st.table} s ON s.cnpj = c.cnpj AND s.ano = {YEAR} GROUP BY m.id_municipio"
            )
    return " UNION ALL ".join(parts)


def _active() -> str:
    parts = [f"SELECT '{st.name}' AS tipo_servico, a.* FROM ({_service_entities(st)}) a" for st in SERVICE_TYPES.values()]
    return " UNION ALL ".join(parts)


def _types() -> str:
    rows = ", ".join(f"({i}, '{st.name}', '{st.title}')" for i, st in enumerate(SERVICE_TYPES.values()))
    return f"SELECT * FROM (VALUES {rows}) AS t(posicao, tipo_servico, titulo)"


# Blanks, tabs and line breaks as SQL text.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def _format_cnpj(expression: str) -> str:
    digits = f"regexp_replace({expression}, '[^0-9]', '', 'g')"
    p = f"lpad({digits}, 14, '0')"
    pieces = f"{p}[1:2] || '.' || {p}[3:5] || '.' || {p}[6:8] || '/' || {p}[9:12] || '-' || {p}[13:14]"
    return f"CASE WHEN length({digits}) > 14 THEN {digits} ELSE {pieces} END"


def _number(expression: str) -> str:
    return f"replace(format('{{:,}}', CAST(COALESCE({expression}, 0) AS BIGINT)), ',', '.')"


def _view_values(view: str) -> str:
    v = VIEWS[view]
    source = {
        "entities": _entity_totals,
        "entities_by_type": lambda: _entities_with_service(SERVICE_TYPES[v.tipo]),
        "services": lambda: _service_totals(SERVICE_TYPES[v.tipo]),
        "fleet": _latest_fleet,
    }[v.source]()
    return f"SELECT id_municipio, CAST({v.metric} AS BIGINT) AS valor FROM ({source})"


def _breaks(view: str) -> str:
    """One row (intervalos) from the relation ``valores``."""
    cases = []
    if VIEWS[view].source == "fleet":
        cases.append("WHEN m > 100000 THEN [i * ((m + 6) // 7) for i in range(0, 8)]")
    cases += [f"WHEN m <= {upper} THEN {list(fixed)}" for upper, fixed in FIXED_BREAKS]
    return (
        f"SELECT CAST(CASE {' '.join(cases)} ELSE [i * ((m + 5) // 6) for i in range(0, 7)] END AS BIGINT[])"
        " AS intervalos FROM (SELECT COALESCE(MAX(valor), 0) AS m FROM valores)"
    )


def _bucket(value: str) -> str:
    return (
        f"CAST(greatest((SELECT COUNT(*) FROM (SELECT unnest(intervalos) AS b FROM quebras) WHERE b <= {value}) - 1, 0)"
        " AS INT)"
    )


def _colour(index: str) -> str:
    return f"({list(PALETTE)})[{index} + 1]"


def _choropleth(view: str, hits: dict[str, str] | None = None, precedence: str = "last") -> str:
    """Features with their class; ``hits`` maps a highlight class to a condition on the feature id."""
    order = list((hits or {}).items())
    if precedence == "last":
        order.reverse()

    def pick(value) -> str:
        if not order:
            return "CAST(NULL AS VARCHAR)"
        return "CASE " + " ".join(f"WHEN {c} THEN '{value(k)}'" for k, c in order) + " END"

    joined = (
        "SELECT g.id, g.name, COALESCE(u.valor, 0) AS valor, u.id_municipio IS NOT NULL AS com_dados FROM geo g"
        " LEFT JOIN (SELECT id_municipio, MAX(valor) AS valor FROM valores GROUP BY id_municipio) u"
        " ON g.id = CAST(u.id_municipio AS VARCHAR)"
    )
    label = VIEWS[view].label
    return _sql(
        f"SELECT id, name, valor, com_dados, faixa, {_colour('faixa')} AS cor,"
        f" CASE WHEN com_dados THEN '{label}: ' || {_number('valor')} ELSE '{NO_DATA_TEXT}' END AS texto,"
        f" {pick(lambda k: k)} AS destaque, {pick(lambda k: HIGHLIGHT_COLOURS[k])} AS cor_destaque"
        f" FROM (SELECT j.*, {_bucket('j.valor')} AS faixa FROM juntos j)",
        valores=_view_values(view),
        quebras=_breaks(view),
        juntos=joined,
    )


def _profile_document(id_municipio: int) -> str:
    lists, totals, joins = [], [], []
    for st in SERVICE_TYPES.values():
        n = st.name
        lists.append(f"{n} := COALESCE(l_{n}.itens, [])")
        detail = ", ".join(
            f"struct_pack(tipo := '{c.label}', quantidade := {n}_{i})" for i, c in enumerate(st.components)
        )
        total = " + ".join(f"{n}_{i}" for i in range(len(st.components)))
        totals.append(f"{n} := struct_pack(total := {total}, detalhamento := [{detail}])")
        joins.append(
            f" LEFT JOIN (SELECT id_municipio, list(struct_pack(cnpj := cnpj, razao_social := razao_social)"
            f" ORDER BY razao_social, cnpj) AS itens FROM ({_service_entities(st)}) GROUP BY id_municipio)"
            f" l_{n} USING (id_municipio)"
        )
        quantities = ", ".join(f"{_quantity(st, i)} AS {n}_{i}" for i in range(len(st.components)))
        joins.append(
            f" LEFT JOIN (SELECT m2.id_municipio, {quantities} FROM municipios m2 LEFT JOIN credenciados c"
            f" USING (id_municipio) LEFT JOIN {st.table} s ON s.cnpj = c.cnpj AND s.ano = {YEAR}"
            f" GROUP BY m2.id_municipio) s_{n} USING (id_municipio)"
        )
    return _sql(
        "SELECT CAST(to_json(struct_pack(id_municipio := m.id_municipio, nome := m.nome,"
        f" credenciados := struct_pack({', '.join(lists)}), servicos := struct_pack({', '.join(totals)})))"
        f" AS VARCHAR) AS json FROM municipios m{''.join(joins)} WHERE m.id_municipio = {id_municipio}"
    )


def _profile_lines() -> str:
    sizes, totals, joins, entities = [], [], [], []
    for st in SERVICE_TYPES.values():
        n, count = st.name, len(st.components)
        sizes.append(f"{n} := COALESCE(l_{n}.tamanho, 0)")
        detail = ", ".join(
            f"struct_pack(tipo := '{c.label}', quantidade := {n}_{i})" for i, c in enumerate(st.components)
        )
        total = " + ".join(f"{n}_{i}" for i in range(count))
        totals.append(f"{n} := struct_pack(total := {total}, detalhamento := [{detail}])")
        joins.append(
            f" LEFT JOIN (SELECT id_municipio, COUNT(*) AS tamanho FROM ({_service_entities(st)}) GROUP BY id_municipio)"
            f" l_{n} USING (id_municipio)"
        )
        quantities = ", ".join(f"{_quantity(st, i)} AS {n}_{i}" for i in range(count))
        joins.append(
            f" LEFT JOIN (SELECT m2.id_municipio, {quantities} FROM municipios m2 LEFT JOIN credenciados c"
            f" USING (id_municipio) LEFT JOIN {st.table} s ON s.cnpj = c.cnpj AND s.ano = {YEAR}"
            f" GROUP BY m2.id_municipio) s_{n} USING (id_municipio)"
        )
        own = " + ".join(_quantity(st, i) for i in range(count))
        entities.append(
            f"SELECT c.id_municipio, '{n}' AS tipo, c.cnpj, c.razao_social, {own} AS total FROM"
            f" (SELECT DISTINCT id_municipio, cnpj, razao_social FROM credenciados) c JOIN {st.table} s"
            f" ON s.cnpj = c.cnpj WHERE s.ano = {YEAR} GROUP BY ALL"
        )
    return _sql(
        "SELECT CAST(to_json(struct_pack(linha := 'municipio', id_municipio := m.id_municipio, nome := m.nome,"
        f" tamanhos := struct_pack({', '.join(sizes)}), servicos := struct_pack({', '.join(totals)})))"
        f" AS VARCHAR) AS json FROM municipios m{''.join(joins)} UNION ALL"
        " SELECT CAST(to_json(struct_pack(linha := 'credenciado', id_municipio := id_municipio, tipo := tipo,"
        " cnpj := cnpj, razao_social := razao_social, total := total)) AS VARCHAR)"
        f" FROM ({' UNION ALL '.join(entities)})"
    )


def oracle_statements() -> dict[str, str]:
    from quadrante.verification.queries import FILTER_CNPJ, FILTER_IDS, FILTER_NAME, LOOKUP_ID

    entity_list = (
        "SELECT DISTINCT c.id_municipio, c.cnpj, c.razao_social, m.nome AS nome_municipio"
        " FROM credenciados c JOIN municipios m USING (id_municipio)"
    )
    # Look-ups search the entity list, which leaves out entities of unknown areas.
    by_name = f"SELECT DISTINCT id_municipio FROM ({entity_list}) WHERE razao_social = '{FILTER_NAME}'"
    by_cnpj = f"SELECT DISTINCT id_municipio FROM ({entity_list}) WHERE {_format_cnpj('cnpj')} = '{FILTER_CNPJ}'"
    id_list = ", ".join(f"'{i}'" for i in FILTER_IDS)
    hits = {
        "municipio": f"id IN ({id_list})",
        "razao_social": f"id IN (SELECT CAST(id_municipio AS VARCHAR) FROM ({by_name}))",
        "cnpj": f"id IN (SELECT CAST(id_municipio AS VARCHAR) FROM ({by_cnpj}))",
    }
    fleet = {"frota": _latest_fleet()}
    out = {
        "municipios": _sql("SELECT id_municipio AS id, nome FROM municipios"),
        "municipio_by_id": _sql(f"SELECT id_municipio, nome FROM municipios WHERE id_municipio = {LOOKUP_ID}"),
        "credenciados": _sql(entity_list),
        "credenciados_total": _sql(_entity_totals()),
        "servicos_ecv_12": _sql(_service_totals(SERVICE_TYPES["ecv"], extended=True)),
        "frotas": _sql(_latest_fleet()),
        "latest_per_key": _sql(
            "SELECT s.* FROM servicos_clinicas s JOIN (SELECT cnpj, MAX(ano) AS ano FROM servicos_clinicas"
            " GROUP BY cnpj) u ON u.cnpj = s.cnpj AND u.ano = s.ano"
        ),
        "frota_long": _sql(_fleet_lines("frota", "id_municipio, ano_frota"), **fleet),
        "frota_detalhe": _sql(
            "SELECT id_municipio, total_frota, tipo, quantidade FROM ("
            + _fleet_lines("frota", "id_municipio, total_frota")
            + ")",
            **fleet,
        ),
        "frotas_json": _sql(
            "SELECT CAST(to_json(struct_pack(id_municipio := id_municipio, nome_municipio := nome_municipio,"
            " populacao := populacao, ano_frota := ano_frota, total_frota := total_frota,"
            " detalhe_frota := struct_pack("
            + ", ".join(f'"{label}" := {column}' for column, label in VEHICLES.items())
            + "))) AS VARCHAR) AS json FROM frota",
            **fleet,
        ),
        "visao_geral": _sql(
            "SELECT t.id_municipio, nome_municipio, total_credenciados, populacao, f.total_frota, tipo, quantidade"
            " FROM (" + _one_total() + ") t LEFT JOIN ("
            + _fleet_lines("uma", "id_municipio, total_frota")
            + ") f USING (id_municipio)",
            totais=_entity_totals(),
            **fleet,
            uma=_one_fleet(),
        ),
        "cabecalho": _sql(
            f"SELECT id_municipio, ordem, rotulo, valor, {_number('valor')} AS texto FROM ("
            f"SELECT id_municipio, 1 AS ordem, '{HEADER_LABELS['populacao']}' AS rotulo, populacao AS valor FROM um"
            f" UNION ALL SELECT id_municipio, 2, '{HEADER_LABELS['total_frota']}', uma.total_frota"
            " FROM um JOIN uma USING (id_municipio))",
            totais=_entity_totals(),
            um=_one_total(),
            **fleet,
            uma=_one_fleet(),
        ),
        "perfil": _sql(
            "SELECT m.id_municipio, m.nome, t.tipo_servico AS tipo,"
            " (SELECT COUNT(*) FROM ativos a WHERE a.id_municipio = m.id_municipio"
            " AND a.tipo_servico = t.tipo_servico) AS n_credenciados,"
            " CAST((SELECT SUM(quantidade) FROM linhas l WHERE l.id_municipio = m.id_municipio"
            " AND l.tipo_servico = t.tipo_servico) AS BIGINT) AS total FROM municipios m, tipos t",
            ativos=_active(),
            linhas=_service_lines(),
            tipos=_types(),
        ),
        "perfil_json": _profile_lines(),
        "perfil_um": _profile_document(LOOKUP_ID),
        "servicos_long": _sql(_service_lines()),
        "secao_credenciados": _sql(
            "SELECT m.id_municipio, t.tipo_servico, t.titulo, COUNT(a.cnpj) OVER"
            " (PARTITION BY m.id_municipio, t.tipo_servico) AS tamanho, a.cnpj IS NULL AS vazio, a.razao_social,"
            f" {_format_cnpj('a.cnpj')} AS cnpj FROM municipios m CROSS JOIN tipos t LEFT JOIN ativos a"
            " ON a.id_municipio = m.id_municipio AND a.tipo_servico = t.tipo_servico",
            ativos=_active(),
            tipos=_types(),
        ),
        "clean_entities": _sql(
            "SELECT cnpj, razao_social, id_municipio, regexp_replace(cnpj, '[^0-9]', '', 'g') AS cnpj_digits,"
            f" {_format_cnpj('cnpj')} AS cnpj_fmt, trim(razao_social) AS razao_social_trim FROM credenciados"
        ),
        "opcoes_razao_social": _sql("SELECT DISTINCT trim(razao_social) AS razao_social FROM credenciados WHERE razao_social <> ''"),
        "opcoes_cnpj": _sql(f"SELECT DISTINCT cnpj AS valor, {_format_cnpj('cnpj')} AS rotulo FROM credenciados"),
        "municipios_por_razao_social": _sql(by_name),
        "municipios_por_cnpj": _sql(by_cnpj),
        "selecao_municipios": _sql(f"SELECT * FROM ({entity_list}) WHERE CAST(id_municipio AS VARCHAR) IN ({id_list})"),
        "selecao_por_tabela": _sql(
            f"SELECT * FROM ({entity_list}) WHERE id_municipio IN (SELECT id_municipio FROM populacao WHERE populacao > 10000)"
        ),
        "feicoes_geojson": _sql("SELECT id, name FROM geo"),
        "eventos_json": "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "limpeza_documentos": (
            "SELECT doc_id AS id_municipio, regexp_replace(text, '[^0-9]', '', 'g') AS cnpj_digits,"
            f" {_format_cnpj('text')} AS cnpj_fmt, trim(text, {_BLANKS}) AS razao_social_trim FROM documents"
        ),
        "opcoes_nomes_documentos": (
            f"SELECT DISTINCT trim(p, {_BLANKS}) AS razao_social FROM (SELECT unnest(string_split(text, '.')) AS p"
            " FROM documents) WHERE p <> ''"
        ),
        "opcoes_cnpj_documentos": (
            f"SELECT DISTINCT valor, {_format_cnpj('valor')} AS rotulo FROM"
            " (SELECT regexp_replace(text, '[^0-9]', '', 'g') AS valor FROM documents) WHERE valor <> ''"
        ),
        "destaque": _choropleth("visao_geral", hits),
        "destaque_primeiro": _choropleth("visao_geral", hits, "first"),
        "resumo_filtros": _sql(
            "SELECT 'municipio' AS filtro, 'Municípios: ' || (SELECT string_agg(COALESCE(m.nome, s.id), ', ' ORDER BY s.pos)"
            f" FROM (VALUES {', '.join(f"({p}, '{i}')" for p, i in enumerate(FILTER_IDS))}) AS s(pos, id)"
            " LEFT JOIN municipios m ON CAST(m.id_municipio AS VARCHAR) = s.id) AS texto,"
            f" '{HIGHLIGHT_COLOURS['municipio']}' AS cor"
            f" UNION ALL SELECT 'razao_social', 'Razão Social: {FILTER_NAME}', '{HIGHLIGHT_COLOURS['razao_social']}'"
            f" UNION ALL SELECT 'cnpj', 'CNPJ: ' || {_format_cnpj(f"'{FILTER_CNPJ}'")}, '{HIGHLIGHT_COLOURS['cnpj']}'"
        ),
        "numero_formatado": _sql(
            f"SELECT id_municipio, nome_municipio, total_exames, {_number('total_exames')} AS texto"
            f" FROM ({_service_totals(SERVICE_TYPES['clinicas'])})"
        ),
    }
    for st in SERVICE_TYPES.values():
        out[f"credenciados_{st.name}"] = _sql(_entities_with_service(st))
        out[f"servicos_{st.name}"] = _sql(_service_totals(st))
        out[f"detalhe_credenciados_{st.name}"] = _sql(_service_entities(st))
        out[f"detalhe_servicos_{st.name}"] = _sql(
            "SELECT id_municipio, CAST(SUM(quantidade) OVER (PARTITION BY id_municipio) AS BIGINT) AS total,"
            " tipo, quantidade FROM linhas",
            linhas=_service_lines((st.name,)),
        )
    for view in VIEWS:
        out[f"coropletico_{view}"] = _choropleth(view)
    for key, view in (("class_breaks", "servicos_cfc"), ("class_breaks_frota", "frota_total")):
        out[key] = _sql(
            "SELECT CAST(unnest(range(0, len(intervalos))) AS INT) AS ordem, unnest(intervalos) AS intervalo FROM quebras",
            valores=_view_values(view),
            quebras=_breaks(view),
        )
    one_area = {"servicos_long": "servicos_long_um", "secao_credenciados": "secao_credenciados_um"}
    for st in SERVICE_TYPES.values():
        one_area |= {f"detalhe_{x}_{st.name}": f"detalhe_{x}_um_{st.name}" for x in ("credenciados", "servicos")}
    for whole, one in one_area.items():
        out[one] = f"SELECT * FROM ({out[whole]}) WHERE id_municipio = {LOOKUP_ID}"
    out["bucketed"] = _sql(
        f"SELECT id_municipio, valor, {_bucket('valor')} AS faixa, {_colour(_bucket('valor'))} AS cor FROM valores",
        valores=_view_values("credenciados_total"),
        quebras=_breaks("credenciados_total"),
    )
    out["legenda"] = _sql(
        f"SELECT ordem, de, ate, {_colour('ordem')} AS cor,"
        f" {_number('de')} || CASE WHEN ate IS NULL THEN '+' ELSE ' – ' || {_number('ate')} END AS texto FROM ("
        "SELECT CAST(ordem AS INT) AS ordem, de, lead(de) OVER (ORDER BY ordem) AS ate FROM (SELECT"
        " unnest(range(0, len(intervalos))) AS ordem, unnest(intervalos) AS de FROM quebras))",
        valores=_view_values("servicos_clinicas"),
        quebras=_breaks("servicos_clinicas"),
    )
    damaged = (
        "SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN left(props, length(props) - 1)"
        """ WHEN event_id % 7 = 0 THEN replace(props, '"k"', '"x"') ELSE props END AS props FROM events"""
    )
    out["eventos_aceitos"] = (
        f"SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM ({damaged})"
        " WHERE json_valid(props) AND json_extract(props, '$.k') IS NOT NULL"
    )
    out["eventos_rejeitados"] = (
        "SELECT event_id, event_type, props, CASE WHEN props IS NULL THEN 'texto ausente' WHEN NOT json_valid(props) THEN 'JSON inválido'"
        f" ELSE 'coluna ausente: k' END AS motivo FROM ({damaged})"
        " WHERE props IS NULL OR NOT json_valid(props) OR json_extract(props, '$.k') IS NULL"
    )
    # The same results from tables that were written and read back.
    for stored, direct in (
        ("load_tables", "perfil"), ("perfil_um_gravado", "perfil_um"), ("municipios_por_cnpj_gravado", "municipios_por_cnpj"),
        ("servicos_mantidos", "servicos_clinicas"),
    ):
        out[stored] = out[direct]
    return out


def without_schema(statement: str) -> str:
    """The same statement for a database that holds the star schema itself as tables."""
    rest = statement.removeprefix(f"WITH {_schema_ctes()}").lstrip()
    return f"WITH {rest[1:]}" if rest.startswith(",") else rest
