"""From rules to evaluation order: rewrites, safety, stratification, variants and join order. No data is touched here."""
