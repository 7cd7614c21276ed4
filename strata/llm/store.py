"""Tables between the steps of an operator, as the library keeps them."""

from strata.sources.shared import folder, input_bytes, materialize, partitions, shared_folder

__all__ = ["folder", "input_bytes", "materialize", "partitions", "shared_folder"]
