"""SQL over measurements, and the catalogue of registered queries."""
