"""The same stateless expressions over streams."""
