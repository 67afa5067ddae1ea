"""Tables in and out, and the flow views over the star schema."""

from .tables import SCHEMAS, publish, publish_layer, read_table

__all__ = ["SCHEMAS", "publish", "publish_layer", "read_table"]
