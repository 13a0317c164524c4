"""Questions and batch builds over a points table."""
