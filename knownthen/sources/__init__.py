"""Where facts come from and go to: fact logs, driver tables, the model registry."""
