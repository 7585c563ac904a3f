"""The feature store and model layers: what to compute, as plans over the operators."""
