"""The row-local plans on unbounded inputs."""
