"""Schemas, service types, vehicle columns and map views of the regional star schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_YEAR = 2024

# The measure columns of a vehicle-inspection fact, in table order.
INSPECTION_MEASURES = (
    "vistoria_lacrada_veic_combinado",
    "vistoria_lacrada_veic_passageiros",
    "vistoria_lacrada_veic_2_3_rodas",
    "vistoria_renave_veic_4_rodas",
    "vistoria_renave_veic_2_3_rodas",
    "vistoria_veic_carga",
    "vistoria_veicular_combinacoes",
    "vistoria_veic_2_3_rodas",
    "vistoria_veic_4_rodas",
    "vistoria_veic_passageiros",
    "outras_vistorias",
)
INSPECTION_EXTRA = "vistoria_veicular_combinacoes_extra"

# Vehicle columns of a fleet snapshot and their display labels.
VEHICLES = {
    "automovel": "Automóvel",
    "caminhao": "Caminhão",
    "caminhoneta_caminhonete": "Caminhoneta/Caminhonete",
    "microonibus": "Micro-ônibus",
    "moto": "Moto",
    "motor_casa": "Motor-casa",
    "onibus": "Ônibus",
    "reboque_semireboque": "Reboque/Semirreboque",
    "trator": "Trator",
    "outros": "Outros",
}

# Map palette, highlight colours and message texts.
PALETTE = ("#FFEDA0", "#FED976", "#FEB24C", "#FD8D3C", "#FC4E2A", "#E31A1C", "#BD0026", "#800026")
HIGHLIGHT_COLOURS = {"municipio": "#3388ff", "razao_social": "#ff6b6b", "cnpj": "#5cb85c"}
NO_DATA_TEXT = "Sem dados disponíveis"
NO_FILTER_TEXT = "Nenhum filtro aplicado"


@dataclass(frozen=True)
class Component:
    """One summed quantity of a service type: the row-wise sum of its measures."""

    label: str
    column: str
    measures: tuple[str, ...]


@dataclass(frozen=True)
class ServiceType:
    name: str
    components: tuple[Component, ...]
    total_column: str
    total_label: str
    title: str

    @property
    def table(self) -> str:
        return f"servicos_{self.name}"

    @property
    def count_column(self) -> str:
        return f"total_{self.name}"

    @property
    def measures(self) -> tuple[str, ...]:
        return tuple(m for c in self.components for m in c.measures)


# The five service types with their measures, labels and section titles.
SERVICE_TYPES = {
    "cfc": ServiceType(
        "cfc",
        (
            Component("Cursos Teóricos", "total_cursos_teoricos", ("cursos_teoricos",)),
            Component("Cursos Práticos", "total_cursos_praticos", ("cursos_praticos",)),
        ),
        "total_cursos",
        "Total de Cursos",
        "CFCs",
    ),
    "clinicas": ServiceType(
        "clinicas",
        (
            Component("Exames Médicos", "total_exames_medicos", ("exames_medicos",)),
            Component("Exames Psicológicos", "total_exames_psicologicos", ("exames_psicologicos",)),
        ),
        "total_exames",
        "Total de Exames",
        "Clínicas",
    ),
    "ecv": ServiceType(
        "ecv",
        (Component("Total Vistorias", "total_vistorias", INSPECTION_MEASURES),),
        "total_vistorias",
        "Total de Vistorias",
        "ECVs",
    ),
    "epiv": ServiceType(
        "epiv",
        (Component("Total Estampagens", "total_estampagens", ("estampagens",)),),
        "total_estampagens",
        "Total de Estampagens",
        "EPIVs",
    ),
    "patio": ServiceType(
        "patio",
        (Component("Total Veículos Removidos", "total_veiculos_removidos", ("veiculos_removidos",)),),
        "total_veiculos_removidos",
        "Total de Veículos Removidos",
        "Pátios",
    ),
}
TYPE_NAMES = tuple(SERVICE_TYPES)


def service_type(tipo: str | None) -> ServiceType:
    """Look a service type up by name, ignoring case; unknown or missing raises ``ValueError``."""
    found = SERVICE_TYPES.get((tipo or "").lower())
    if found is None:
        raise ValueError(f"unknown service type {tipo!r}; expected one of {', '.join(TYPE_NAMES)}")
    return found


@dataclass(frozen=True)
class View:
    """A map view: where its rows come from, which column it colours, which sections it shows."""

    name: str
    source: str  # "entities" | "entities_by_type" | "services" | "fleet"
    metric: str
    label: str
    tipo: str | None = None
    sections: tuple[str, ...] = ()


def _build_views() -> dict[str, View]:
    views = [
        View("visao_geral", "entities", "populacao", "População", sections=TYPE_NAMES),
        View("credenciados_total", "entities", "total_credenciados", "Total de Credenciados"),
        View("frota_total", "fleet", "total_frota", "Total de Frota"),
    ]
    for t in SERVICE_TYPES.values():
        views.append(
            View(f"credenciados_{t.name}", "entities_by_type", t.count_column,
                 f"Total de {t.title}", t.name, (t.name,))
        )
        views.append(
            View(f"servicos_{t.name}", "services", t.total_column, t.total_label, t.name, (t.name,))
        )
    return {v.name: v for v in views}


VIEWS = _build_views()


def map_view(name: str) -> View:
    """Look a view up; an unknown name behaves as the plain entity count."""
    return VIEWS.get(name, VIEWS["credenciados_total"])


def _long_columns(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _fact_schema(*measures: str) -> T.StructType:
    return T.StructType(
        [T.StructField("cnpj", T.StringType()), T.StructField("ano", T.IntegerType())]
        + _long_columns(*measures)
    )


_AREA_ID = T.StructField("id_municipio", T.IntegerType())

SCHEMAS = {
    "municipios": T.StructType([_AREA_ID, T.StructField("nome", T.StringType())]),
    "credenciados": T.StructType(
        [T.StructField("cnpj", T.StringType()), T.StructField("razao_social", T.StringType()), _AREA_ID]
    ),
    **{t.table: _fact_schema(*t.measures) for t in SERVICE_TYPES.values()},
    "populacao": T.StructType([_AREA_ID, *_long_columns("populacao")]),
    "frotas": T.StructType(
        [_AREA_ID, T.StructField("ano", T.IntegerType()), *_long_columns(*VEHICLES)]
    ),
}

# Columns a table may carry beyond its schema.
OPTIONAL_COLUMNS = {"servicos_ecv": _long_columns(INSPECTION_EXTRA)}


@dataclass(frozen=True)
class Tables:
    """The nine tables of the star schema; every operator reads only the ones it needs.

    A table may be given as a function, which is called when the table is first used: listing the files and reading the schema of
    tables that a query does not touch costs nothing.
    """

    municipios: DataFrame | Callable[[], DataFrame]
    credenciados: DataFrame | Callable[[], DataFrame]
    servicos_cfc: DataFrame | Callable[[], DataFrame]
    servicos_clinicas: DataFrame | Callable[[], DataFrame]
    servicos_ecv: DataFrame | Callable[[], DataFrame]
    servicos_epiv: DataFrame | Callable[[], DataFrame]
    servicos_patio: DataFrame | Callable[[], DataFrame]
    populacao: DataFrame | Callable[[], DataFrame]
    frotas: DataFrame | Callable[[], DataFrame]

    def __getattribute__(self, name: str):
        value = object.__getattribute__(self, name)
        if name in Tables.__dataclass_fields__ and callable(value):
            value = value()
            object.__setattr__(self, name, value)
        return value

    def services(self, tipo: str) -> DataFrame:
        return getattr(self, service_type(tipo).table)

    def with_tables(self, **changed: DataFrame | Callable[[], DataFrame]) -> Tables:
        """These tables with others in their place; none is resolved by it."""
        return Tables(**{n: changed.get(n, object.__getattribute__(self, n)) for n in Tables.names()})

    @classmethod
    def names(cls) -> tuple[str, ...]:
        return tuple(f.name for f in fields(cls))
