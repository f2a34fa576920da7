"""Plan helpers: durable materialisation and table access."""
