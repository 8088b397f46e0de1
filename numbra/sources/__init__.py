"""Tables from files, generators and sinks."""
