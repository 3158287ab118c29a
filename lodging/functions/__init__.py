"""Column-expression rules: revenue, guest type, region, season, dates, money text."""
