"""Regional service analytics on Spark: areas, accredited entities, yearly services and fleets."""

from quadrante.model import DEFAULT_YEAR, SERVICE_TYPES, VIEWS, Tables

__all__ = ["DEFAULT_YEAR", "SERVICE_TYPES", "VIEWS", "Tables"]
