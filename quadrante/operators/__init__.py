from quadrante.operators.areas import area_by_id, area_list, require_row
from quadrante.operators.classes import class_breaks, legend, with_buckets
from quadrante.operators.entities import (
    active_entities,
    entities_with_service,
    entity_list,
    entity_rows,
    entity_totals,
    service_entities,
)
from quadrante.operators.filters import (
    areas_by_cnpj,
    areas_by_name,
    clean_entities,
    cnpj_options,
    filter_summary,
    highlight,
    name_options,
    select_areas,
)
from quadrante.operators.fleet import fleet_rows, latest_fleet, nest_fleet
from quadrante.operators.latest import latest_per_key, one_per_key
from quadrante.operators.reduction import reduced_year, write_reduction
from quadrante.operators.services import service_details, service_rows, service_totals

__all__ = [
    "active_entities",
    "area_by_id",
    "area_list",
    "areas_by_cnpj",
    "areas_by_name",
    "class_breaks",
    "clean_entities",
    "cnpj_options",
    "entities_with_service",
    "entity_list",
    "entity_rows",
    "entity_totals",
    "filter_summary",
    "fleet_rows",
    "highlight",
    "latest_fleet",
    "latest_per_key",
    "legend",
    "name_options",
    "nest_fleet",
    "one_per_key",
    "reduced_year",
    "require_row",
    "select_areas",
    "service_details",
    "service_entities",
    "service_rows",
    "service_totals",
    "with_buckets",
    "write_reduction",
]
