from quadrante.plans.choropleth import choropleth, join_features, view_breaks, view_legend, view_values
from quadrante.plans.overview import header_facts, one_fleet_per_area, one_total_per_area, overview
from quadrante.plans.profile import area_profile, entity_activity, profile_lines, profile_rows, section_entities
from quadrante.plans.views import metric_value, popup_text, view_rows

__all__ = [
    "area_profile",
    "choropleth",
    "entity_activity",
    "header_facts",
    "join_features",
    "metric_value",
    "one_fleet_per_area",
    "one_total_per_area",
    "overview",
    "popup_text",
    "profile_lines",
    "profile_rows",
    "section_entities",
    "view_breaks",
    "view_legend",
    "view_rows",
    "view_values",
]
