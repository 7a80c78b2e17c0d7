"""The dimensional model, KPIs and product-fit reports built from the operators."""
